from .ids import (  # noqa: F401
    binary_role,
    donor_id,
    draw_key,
    key_problem,
    looks_like_gene,
    normalize_label,
    project_code,
    strip_version,
    valid_md5,
    valid_uuid,
)
from .numeric import (  # noqa: F401
    argmax_class,
    call,
    check_fraction,
    decode_log2_tpm001,
    direction_if_high,
    finite_or_null,
    is_finite,
    log2_tpm1,
    preview,
    sigmoid,
    softmax,
    to_number,
)
