"""Column helpers that check questions and callers before any costly stage."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import strip
from foliospark.schemas import DOC_TYPES

MAX_QUESTION_CHARS = 1000
REQUESTS_PER_DAY = 25

# The rejected instruction-override patterns (case-insensitive).
INJECTION_PATTERNS = (
    r"ignore\s+(?:all\s+|any\s+)?(?:the\s+|your\s+)?(?:previous|prior|above|earlier|preceding|foregoing)\s+(?:instruction|prompt|rule|message|direction)",
    r"disregard\s+(?:all\s+|any\s+)?(?:the\s+|your\s+)?(?:previous|prior|above|earlier|system)\s+(?:instruction|prompt|rule)",
    r"forget\s+(?:all\s+|everything\s+|your\s+|the\s+)?(?:previous\s+|prior\s+|above\s+)?(?:instruction|rule|system\s+prompt)",
    r"(?:reveal|show|print|repeat|expose|leak|display)\s+(?:me\s+)?(?:your\s+|the\s+)?(?:full\s+)?(?:system\s+)?(?:prompt|instruction)",
    r"you\s+are\s+now\s+(?:a|an|the|no longer|going to)",
    r"pretend\s+(?:to\s+be|you\s+are|that\s+you)",
    r"\bnew\s+(?:system\s+)?(?:instruction|prompt|rule)s?\s*[:\-]",
    r"\b(?:do anything now|dan mode|jailbreak|developer mode)\b",
    r"(?:override|bypass|disable|turn off)\s+(?:your\s+|the\s+|all\s+)?(?:instruction|rule|system|safety|guardrail|restriction|filter)",
)


def looks_like_injection(text: Column) -> Column:
    return reduce(or_, (text.rlike(f"(?iU){p}") for p in INJECTION_PATTERNS))


def rejection(question: Column, doc_type: Column, top_k: Column,
              max_chars: int = MAX_QUESTION_CHARS) -> Column:
    """Struct (status, reason) of the first failed check; both null when accepted."""

    def failed(status: int, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    return (
        F.when(F.coalesce(strip(question), F.lit("")) == "", failed(400, "question_required"))
        .when(~doc_type.isin(*DOC_TYPES), failed(400, "doc_type"))
        .when(top_k <= 0, failed(400, "top_k"))
        .when(F.length(question) > max_chars, failed(413, "too_long"))
        .when(looks_like_injection(question), failed(400, "injection"))
    )


def client_ip(forwarded_for: Column, real_ip: Column) -> Column:
    first_hop = strip(F.split_part(forwarded_for, F.lit(","), F.lit(1)))
    return (
        F.when(F.length(forwarded_for) > 0, first_hop)
        .when(F.length(real_ip) > 0, strip(real_ip))
        .otherwise(F.lit("unknown"))
    )


def anonymise_ip(ip: Column) -> Column:
    return F.substring(F.sha2(ip, 256), 1, 12)
