"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from paperloom.session import ship

from .convrepair import OP13_SQL, op13_conversation_repair
from .coversearch import OP1_SQL, op1_top_k
from .decontaminate import OP5_SQL, op5_decontamination
from .fillmiddle import OP12_SQL, op12_fill_in_middle
from .langid import op11_language_id
from .mixing import op6_mixing
from .pii import op4_pii
from .secrets import OP10_SQL, op10_secrets
from .sharding import OP2_SQL, op2_sharding
from .simhash import op8_simhash_near_dedup
from .substrings import OP3_SQL, op3_substring_dedup
from .toxicity import op9_toxicity
from .urlfilter import op7_url_filter


def _shipped(f: Callable) -> Callable:
    """The executors get the package before the query is planned."""

    @wraps(f)
    def run(spark, sf_dir: str):  # noqa: ANN001, ANN202
        return f(ship(spark), sf_dir)

    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        op1_top_k,
        op2_sharding,
        op3_substring_dedup,
        op4_pii,
        op5_decontamination,
        op6_mixing,
        op7_url_filter,
        op8_simhash_near_dedup,
        op9_toxicity,
        op10_secrets,
        op11_language_id,
        op12_fill_in_middle,
        op13_conversation_repair,
    )
}

ORACLE: dict[str, str] = {
    "op1_top_k": OP1_SQL,
    "op2_sharding": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op5_decontamination": OP5_SQL,
    "op10_secrets": OP10_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
