"""One query per operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import exact_dedup, filter_audit, language, lexical, minhash_forest, mixing, packing, pii, secret_scan, simhash, token_counts, token_files, vptree

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as token ids in files, told again from the files."""
    path = scratch_path(spark, "token_files")
    token_files.write_token_files(documents(spark, sf_dir), path, BYTE_BPE, END_ID)
    return token_files.read_documents(spark, path)


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text."""
    return token_counts.count_tokens(documents(spark, sf_dir), BYTE_BPE)


@query(
    """select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
              doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
       from documents window w as (partition by coalesce(text, ''))"""
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts; the largest doc_id of each stays."""
    return exact_dedup.dedup(documents(spark, sf_dir))


@query()
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by compression."""
    return language.identify(documents(spark, sf_dir))


@query()
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.digests(pii.find(documents(spark, sf_dir)))


@query()
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.digests(secret_scan.scan(documents(spark, sf_dir)))


@query()
def op8_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vptree.nearest(embeddings, F.col("vec_id") % 100 == 0)


@query()
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    return mixing.taken(documents(spark, sf_dir))


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), BYTE_BPE, END_ID)


@query()
def op11_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their word pairs."""
    return minhash_forest.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


@query(
    r"""with terms as (
          select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
        sizes as (select doc_id, ts, len(ts) as n from terms where len(ts) > 0),
        whole as (select count(*) as docs, sum(n)::bigint as total from sizes),
        postings as (select doc_id, any_value(n) as n, term, count(*) as tf
                     from (select doc_id, n, unnest(ts) as term from sizes) group by doc_id, term),
        df as (select term, count(*) as df from postings group by term),
        asked as (select item_id, term, count(*) as times
                  from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)
                  group by item_id, term),
        weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from df, whole),
        scores as (select item_id, doc_id,
                          sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::bigint as score
                   from asked join weights using (term) join postings using (term), whole group by item_id, doc_id)
        select item_id, rank::int as rank, doc_id, score
        from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
        where rank <= 20"""
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents that rank highest for each benchmark item."""
    path = scratch_path(spark, "lexical")
    lexical.build_index(documents(spark, sf_dir), path)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return lexical.search(spark, path, items).select("item_id", "rank", "doc_id", "score")


@query(
    r"""with words as (
          select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws
          from documents),
        masks as (
          select doc_id, part,
                 (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int
                 + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::int
                 + 8 * regexp_matches(text, '[#$%&*|]')::int
                 + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask
          from words),
        told as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
        counts as (
          select part, mask, count(*) as n, sum(coalesce(good, 0))::bigint as good, sum(coalesce(toxic, 0))::bigint as toxic
          from masks left join told using (doc_id) group by part, mask),
        letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as v(letter, bit)),
        orders as (
          select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order,
                 [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
          from letters a, letters b, letters c, letters d, letters e
          where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        steps as (
          select filter_order, step::int as step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier
          from orders, (select unnest(range(1, 6)) as step)),
        figures as (
          select part, filter_order, step, any_value(bit) as bit,
                 sum(case when mask & (earlier + bit) = 0 then n else 0 end)::bigint as kept,
                 sum(case when mask & earlier = 0 and mask & bit > 0 then n else 0 end)::bigint as removed,
                 sum(case when mask & earlier > 0 and mask & bit > 0 then n else 0 end)::bigint as redundant,
                 sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
                 sum(case when mask & earlier = 0 and mask & bit > 0 then good else 0 end)::bigint as good_lost,
                 sum(case when mask & earlier = 0 and mask & bit > 0 then toxic else 0 end)::bigint as toxic_lost
          from counts, steps group by part, filter_order, step)
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) over (partition by part, bit)::bigint as shapley
        from figures"""
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters do to each language in all 120 orders."""
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
