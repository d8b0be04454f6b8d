"""Column rules of requests, estimates and notices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an error's message holds, and the code that it gets; the first that fits counts.
ERRORS = {
    "GEN_API_KEY_INVALID": ["API key", "Incorrect API key", "invalid_api_key"],
    "GEN_STREAM_TIMEOUT": ["idle-timeout"],
    "GEN_STREAM_INTERRUPTED": ["terminated", "socket hang up", "aborted"],
    "GEN_NETWORK": ["Connection", "ECONNREFUSED", "ETIMEDOUT", "fetch failed", "ENOTFOUND"],
    "GEN_TOO_LONG": ["token count", "too long", "context length", "maximum context"],
    "VISION_NOT_CONFIGURED": ["VISION_NOT_CONFIGURED"],
    "VISION_NO_TEXT_FOUND": ["VISION_NO_TEXT_FOUND"],
    "VISION_INPUT_INVALID": ["VISION_TOO_MANY_IMAGES", "VISION_IMAGE_TOO_LARGE", "VISION_INVALID_IMAGE"],
    "VISION_MODEL_UNAVAILABLE": ["only support text messages", "ModelNotOpen", "InvalidEndpointOrModel"],
    "GEN_REGION_UNSUPPORTED": ["400", "404"],
}
OTHER_ERROR = "GEN_AI_UNAVAILABLE"
#: Characters of a chunk by model, those of other models, the least, and what the highest tier gets.
CHUNKS = {"gemini-flash": 12000, "gemini-pro": 16000, "doubao": 9000, "deepseek": 6000}
OTHER_CHUNK, LEAST_CHUNK, TOP_TIER_FACTOR = 12000, 4000, 1.35
#: Price in cents and days of each plan.
PRICES = {"plus_monthly": (499, 30), "plus_yearly": (4999, 365), "pro_monthly": (899, 30), "pro_yearly": (8999, 365), "ultra_monthly": (1399, 30), "ultra_yearly": (13999, 365)}
#: Content characters by tier, and of a payload with its images.
CONTENT_LIMITS = {"FREE": 200_000, "PLUS": 2_000_000, "PRO": 2_000_000, "ULTRA": 2_000_000}
RAW_LIMIT = 60_000_000
#: Fields that logs don't show.
SECRET_FIELDS = ["password", "passwordHash", "token", "authorization", "cookie"]


def trimmed(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def file_name(text: Column, otherwise: str = "pasted") -> Column:
    """A name from the first sentence of the first line that isn't blank, of 30 characters at most; blank texts have the name of a document."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trimmed), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    sentence = trimmed(F.element_at(F.split(first, "[。.!?！？]"), 1))
    base = trimmed(F.regexp_replace(F.substring(F.when(sentence != "", sentence).otherwise(first), 1, 30), r'[\\/:*?"<>|]', ""))
    return F.concat(F.when(first == "", "document").when(base != "", base).otherwise(F.lit(otherwise)), F.lit(".txt"))


def is_member(value: Column, listed: Column) -> Column:
    """Whether a value is in a comma-separated list; null and empty values aren't."""
    members = F.filter(F.transform(F.split(listed, ","), trimmed), lambda x: x != "")
    return F.coalesce((value != "") & F.array_contains(members, value), F.lit(False))


def missing(value: Column) -> Column:
    return value.isNull() | (value == "")


def payload(raw: Column, chars: Column, tier: Column) -> Column:
    """What is wrong with a payload: ``too_large`` as sent, ``too_long`` for its tier once images are out; null if nothing.

    ``raw`` and ``chars`` are its lengths with images and without.
    """
    most = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CONTENT_LIMITS.items() for x in kv)), tier), F.lit(CONTENT_LIMITS["FREE"]))
    return F.when(raw > RAW_LIMIT, "too_large").when(chars > most, "too_long")


def progress(status: Column) -> Column:
    """(kind, part, parts) of a status line such as ``PARTIAL_GENERATING|2|5``; null for other lines."""
    parts = F.split(status, r"\|")
    return F.when(status.rlike(r"^(?:PARTIAL_GENERATING|PART_COMPLETE)\|"), F.struct(parts[0].alias("kind"), F.get(parts, F.lit(1)).cast("int").alias("part"), F.get(parts, F.lit(2)).cast("int").alias("parts")))


def notice(truncated: Column, retention: Column, severities: Column) -> Column:
    """(level, reason) of the notice that a report gives; null where it gives none."""
    serious = F.filter(severities, lambda s: s != "info")
    level = F.when(F.array_contains(serious, "critical"), "critical").otherwise("warning")
    reason = F.when(truncated, "truncated").when(retention < 90, "retention").when(F.size(serious) > 0, "issues")
    return F.when(reason.isNotNull(), F.struct(level.alias("level"), reason.alias("reason")))


def compact_number(n: Column) -> Column:
    """Thousands with one decimal above a thousand, else the number; null is 0."""
    return F.when(n > 1000, F.concat(F.format_string("%.1f", n / 1000), F.lit("k"))).otherwise(F.coalesce(n, F.lit(0)).cast("string"))


def chunk_size(model: Column, tier: Column) -> Column:
    sizes = F.create_map(*(F.lit(x) for kv in CHUNKS.items() for x in kv))
    factor = F.when(tier == "ULTRA", TOP_TIER_FACTOR).otherwise(1.0)
    return F.greatest(F.lit(LEAST_CHUNK), F.floor(F.coalesce(F.element_at(sizes, model), F.lit(OTHER_CHUNK)) * factor))


def safe_slice(html: Column, length: Column) -> Column:
    """How many characters may be cut off the front without ending inside a tag."""
    front = F.reverse(F.substring(html, F.lit(1), length))
    back = lambda mark: F.when(F.instr(front, mark) == 0, -1).otherwise(length - F.instr(front, mark))
    return F.when(length >= F.length(html), F.length(html)).when(back("<") > back(">"), back("<")).otherwise(length).cast("int")


def signed(params: Column, key: str) -> Column:
    """The signature of a map of parameters: sorted by name, empty ones and ``sign`` left out."""
    used = F.map_filter(params, lambda k, v: (k != "sign") & v.isNotNull() & (v != ""))
    pairs = F.transform(F.array_sort(F.map_keys(used)), lambda k: F.concat(k, F.lit("="), F.element_at(used, k)))
    return F.upper(F.md5(F.concat(F.array_join(pairs, "&"), F.lit(f"&key={key}")).cast("binary")))


def refund_number(order: Column, millis: Column) -> Column:
    own = F.right(F.regexp_replace(order, "[^A-Za-z0-9_-]", ""), F.lit(32))
    return F.substring(F.concat(F.lit("RF_"), own, F.lit("_"), F.lower(F.conv(millis.cast("string"), 10, 36))), 1, 64)


def data_url_bytes(url: Column) -> Column:
    """Bytes that a data URL holds, about."""
    return F.floor(F.length(F.coalesce(F.get(F.split(url, ","), F.lit(1)), F.lit(""))) * 3 / 4)


def headings_lost(source: Column, output: Column, has_skeleton: Column) -> Column:
    """``early_stop`` if three in ten headings or more are lost, ``headings_reduced`` if fewer, null if none."""
    lost = source - output
    return F.when(~has_skeleton & (source > 0) & (lost > 0), F.when(lost / source >= 0.3, "early_stop").otherwise("headings_reduced"))
