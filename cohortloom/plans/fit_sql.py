"""Fits in SQL: accelerated gradient steps down the same strictly convex objective.

Views for DuckDB. ``side_rows(side, sample, y)`` names the training rows of each fit; genes are
chosen and scaled per side, ``walk`` takes the steps, and ``fitted`` has each side's last point.
The step length comes from a bound on the curvature, so the walk cannot diverge, and its number
of steps leaves an error far below the digits that are compared.
"""

from __future__ import annotations

from . import fixtures as fx


def recursive(*views: str, body: str) -> str:
    return "with recursive " + ",\n".join(views) + "\n" + body


def selection(k: int) -> str:
    """``sel(side, pos, j, n, mean, scale)``: the k best genes by F, numbered by position."""
    return f"""side_cells as (select s.side, s.sample, s.y, e.pos, e.value from side_rows s join expression e using (sample)),
cls as (select side, pos, y, count(*) as n, avg(value) as m, var_pop(value) as v from side_cells group by side, pos, y),
tot as (select side, pos, sum(n) as n, count(*) as k, sum(n*m)/sum(n) as grand from cls group by side, pos),
fs as (select c.side, c.pos, any_value(t.n) as n, any_value(t.grand) as mean, sqrt(sum(c.n*(c.v+(c.m-t.grand)^2))/any_value(t.n)) as sd,
  (sum(c.n*(c.m-t.grand)^2)/(any_value(t.k)-1))/(sum(c.n*c.v)/(any_value(t.n)-any_value(t.k))) as f from cls c join tot t using (side, pos) group by c.side, c.pos),
sel as (select side, pos, row_number() over (partition by side order by pos) as j, n, mean, case when sd=0 then 1 else sd end as scale
  from (select *, row_number() over (partition by side order by f desc, pos desc) as r from fs) where r<={k})"""


def _train(weight: str) -> str:
    """``train(side, sample, y, w, z)``: standardised genes and a one for the intercept."""
    return f"""sizes as (select side, y, count(*) as ny from side_rows group by side, y),
train as (select c.side, c.sample, any_value(c.y) as y, any_value({weight}) as w, list_append(list((c.value-s.mean)/s.scale order by s.j), 1.0::double) as z
  from side_cells c join sel s using (side, pos) join sizes q on c.side=q.side and c.y=q.y group by c.side, c.sample)"""


def _walk(unknowns: int, genes: int, c: float, curvature: float, rest: str, sums: list[str], steps: int) -> str:
    zeros = f"[0.0::double for i in range({unknowns})]"
    return f"""lip as (select side, {curvature}*sum(w*list_dot_product(z,z))+{1 / c} as l from train group by side),
walk as (
  select side, 0 as it, l, (sqrt(l*{c})-1)/(sqrt(l*{c})+1) as beta, {zeros} as th, {zeros} as v from lip
  union all
  select side, it+1, l, beta, nxt, list_transform(range(1,{unknowns + 1}), lambda i: nxt[i]+beta*(nxt[i]-th[i])) from (
    select side, it, l, beta, th, list_transform(range(1,{unknowns + 1}), lambda i: v[i]-(g[i]+case when i%{genes + 1}>0 then v[i]/{c} else 0 end)/l) as nxt from (
      select side, it, any_value(l) as l, any_value(beta) as beta, any_value(th) as th, any_value(v) as v, [{", ".join(sums)}] as g from (
        {rest}) group by side, it))),
fitted as (select side, th from walk where it={steps})"""


def binary_fit(k: int, c: float, steps: int = 600) -> str:
    """Two classes, balanced weights; a point has k coefficients and the intercept."""
    rest = f"select s.*, t.z, t.w*(1/(1+exp(-list_dot_product(s.v,t.z)))-t.y) as r from walk s join train t using (side) where s.it<{steps}"
    sums = [f"sum(r*z[{j}])" for j in range(1, k + 2)]
    return ",\n".join([selection(k), _train("s.n/(2.0*q.ny)"), _walk(k + 1, k, c, 0.25, rest, sums, steps)])


def softmax_fit(classes: tuple[str, ...], k: int, c: float, steps: int = 2500) -> str:
    """Many classes; a point has the classes' coefficients and intercepts one after the other."""
    u, m = k + 1, len(classes)
    logits = ", ".join(f"list_dot_product(s.v[{a * u + 1}:{(a + 1) * u}],t.z) as s{a}" for a in range(m))
    top = "greatest(" + ",".join(f"s{a}" for a in range(m)) + ")"
    shares = ", ".join(f"exp(s{a}-{top}) as e{a}" for a in range(m))
    total = "+".join(f"e{a}" for a in range(m))
    gaps = ", ".join(f"e{a}/({total})-case when y='{name}' then 1 else 0 end as r{a}" for a, name in enumerate(classes))
    rest = f"""select *, {gaps} from (select *, {shares} from (
          select s.*, t.z, t.y, {logits} from walk s join train t using (side) where s.it<{steps}))"""
    sums = [f"sum(r{a}*z[{j}])" for a in range(m) for j in range(1, u + 1)]
    return ",\n".join([selection(k), _train("1.0"), _walk(m * u, k, c, 0.5, rest, sums, steps)])


def held_cells(k: int) -> str:
    """``held_z(side, sample, z)`` of ``held_rows(side, sample)``, scaled as their side."""
    return """held_z as (select h.side, h.sample, list_append(list((e.value-s.mean)/s.scale order by s.j), 1.0::double) as z
  from held_rows h join expression e using (sample) join sel s on s.side=h.side and s.pos=e.pos group by h.side, h.sample)"""


BINARY_HELD = "held as (select side, sample, 1/(1+exp(-list_dot_product(th,z))) as p from held_z join fitted using (side))"


def softmax_held(classes: tuple[str, ...], k: int) -> str:
    """``held(side, sample, class, p)``."""
    u = k + 1
    scores = "[" + ",".join(f"list_dot_product(th[{a * u + 1}:{(a + 1) * u}],z)" for a in range(len(classes))) + "]"
    names = "[" + ",".join(f"'{c}'" for c in classes) + "]"
    return f"""held_s as (select side, sample, {scores} as s from held_z join fitted using (side)),
held as (select side, sample, unnest({names}) as class, unnest(list_transform(s, lambda x: exp(x-list_max(s))/list_sum(list_transform(s, lambda y: exp(y-list_max(s)))))) as p from held_s)"""


SINGLE = (fx.EXPRESSION, fx.METADATA, "side_rows as (select 0 as side, sample, y from metadata where not is_test)")
