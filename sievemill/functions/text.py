"""Column functions on code and text; each is a built-in expression, without shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token and identifier forms (letters and digits of any script), and the words of runtime APIs.
TOKEN = r"[A-Za-z_$][\p{L}\p{N}_$]*|\p{Nd}+|[^\s]"
IDENTIFIER = r"[A-Za-z_$][\p{L}\p{N}_$]*"
DENIED = ["async", "await", "Promise", "setTimeout", "setInterval", "queueMicrotask", "fetch", "WebSocket", "require", "process", "Buffer", "globalThis", "window", "document"]
DENYLIST = r"\b(?:" + "|".join(DENIED) + r")\b"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def identifiers(c: Column) -> Column:
    """Distinct identifiers."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0)))


def entropy(items: Column, kind: str = "string") -> Column:
    """Shannon entropy in bits of an array's items (of the type `kind`), 0 if it is empty; null of null.

    Runs of the sorted array are folded in the row: log2(n) - sum(c * log2(c)) / n, so no token leaves its row.
    """
    zero = F.struct(F.lit(None).cast(kind).alias("last"), F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))

    def step(a, t):
        same = F.coalesce(a["last"] == t, F.lit(False))
        return F.struct(t.alias("last"), F.when(same, a["c"] + 1.0).otherwise(F.lit(1.0)).alias("c"), F.when(same | (a["c"] == 0), a["s"]).otherwise(a["s"] + a["c"] * F.log2(F.greatest(a["c"], F.lit(1.0)))).alias("s"))

    s = F.aggregate(F.array_sort(items), zero, step, lambda a: a["s"] + a["c"] * F.log2(F.greatest(a["c"], F.lit(1.0))))
    return F.when(F.size(items) > 0, F.log2(F.size(items).cast("double")) - s / F.size(items)).when(items.isNotNull(), F.lit(0.0))


def token_stats(c: Column) -> Column:
    """n and h of a text's tokens: how many they are, and their entropy. They are taken out once, and sorted as 64-bit
    hashes, which compare faster than texts."""
    hashed = F.transform(tokens(c), lambda t: F.xxhash64(t))
    return F.element_at(F.transform(F.array(hashed), lambda t: F.struct(F.size(t).alias("n"), entropy(t, "bigint").alias("h"))), 1)


def entropy_of(c: Column) -> Column:
    """Entropy of a text's tokens."""
    return token_stats(c)["h"]


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def dedup_hash(c: Column) -> Column:
    """sha256 of the stripped text: the key of first-wins deduplication."""
    return F.sha2(stripped(c), 256)


def audit_hash(c: Column) -> Column:
    """sha256 with runs of white space as one space: the key of audits."""
    return F.sha2(stripped(F.regexp_replace(c, r"\s+", " ")), 256)


def payload_hash(c: Column) -> Column:
    """sha256 of the exact text: the key of splits."""
    return F.sha2(c, 256)


def between(c: Column, name: str) -> Column:
    """What stands between the first marks === name === and === END name ===; null without both."""
    form = rf"(?s)=== {name} ===\n(.*?)\n=== END {name} ==="
    return F.when(c.rlike(form), F.regexp_extract(c, form, 1))


def code_of(c: Column) -> Column:
    """The code of an instruction, or all of it where it has no marks."""
    return F.coalesce(between(c, "CODE"), c)


def lines(c: Column) -> Column:
    """Lines as a split at line feeds counts them: a last line feed begins an empty line."""
    return F.size(F.split(c, r"\r?\n", -1))


def lines_closed(c: Column) -> Column:
    """Lines as a reader counts them: a last line feed ends a line; an empty text has none."""
    return F.when(c == "", F.lit(0)).otherwise(lines(c) - F.when(c.rlike(r"\n\z"), F.lit(1)).otherwise(F.lit(0)))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def uint32(text: Column) -> Column:
    """The first four bytes of a text's sha256, big-endian, as long."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def uniform(seed: Column, name: str) -> Column:
    """A number in [0, 1) for one decision under a seed; equal seeds and names give equal numbers anywhere."""
    return uint32(F.concat(seed.cast("string"), F.lit(f":{name}"))) / float(2**32)


def stable_key(c: Column, seed: int) -> Column:
    """A key whose order is a repeatable shuffle."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)


def _mul32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit values; halves of 16 bits keep each step within 64."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16).bitwiseAND(F.lit(0xFFFF))
    return (low * b + (high * b.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)).bitwiseAND(F.lit(0xFFFFFFFF))


def mulberry32(seed: Column, draw: Column) -> Column:
    """The draw-th number (from 1) of the 32-bit generator of that name, in [0, 1): its state only adds a constant."""
    m = F.lit(0xFFFFFFFF)
    s = (seed.cast("long") + draw.cast("long") * F.lit(0x6D2B79F5)).bitwiseAND(m)
    v = _mul32(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    w = (v + _mul32(v.bitwiseXOR(F.shiftright(v, 7)), v.bitwiseOR(F.lit(61)))).bitwiseAND(m)
    v = v.bitwiseXOR(w)
    return v.bitwiseXOR(F.shiftright(v, 14)) / float(2**32)


def complexity_class(cc: Column) -> Column:
    return F.when(cc <= 2, "light").when(cc <= 5, "medium").otherwise("heavy")


def source_type(sources: Column, given: Column) -> Column:
    """The given type if it is one; else synthetic if every source says so, real otherwise."""
    return F.when(given.isin("real", "synthetic"), given).when(F.forall(sources, lambda s: F.lower(s).contains("synthetic")) & (F.size(sources) > 0), "synthetic").otherwise("real")


def sanitised(sources: Column) -> Column:
    """Sorted distinct labels of sources, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.when(F.lower(s).contains("synthetic"), "synthetic").otherwise("real")))), ",")
