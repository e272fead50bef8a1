"""Column expressions shared by the operators. Nothing here shuffles or leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: A number as text; a cast of anything else would raise and catch an exception a row.
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"


def to_double(c: Column) -> Column:
    """Lenient number: null where the text is no number. Java's `1d` and `1.0f` are refused, NaN becomes null."""
    text = c.cast("string")
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def number_of(df: DataFrame, name: str) -> Column:
    """to_double of a column; numeric types don't take the way through text."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        x = q(name).cast("double")
        return F.when(~F.isnan(x), x)
    return to_double(q(name))


def finite(c: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def hash_order(seed: int, salt: str, *key: Column) -> Column:
    """The repeatable random order: md5 of seed, salt and row key, the same text in every SQL engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[k.cast("string") for k in key]))


def contains_any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


#: Ordered substring rules of the raw label's family; the first that matches counts.
FAMILY_RULES = (
    ("dos_ddos", ("ddos", "flood", "slowloris"), "dos"),
    ("mirai", ("mirai",), None),
    ("recon", ("recon", "scan", "fingerprint", "vulnerability"), None),
    ("spoofing_mitm", ("mitm", "spoof"), None),
    ("brute_force", ("bruteforce", "dictionary", "password"), None),
    ("web_injection", ("sql", "xss", "injection", "browserhijacking", "upload"), None),
    ("malware", ("backdoor", "ransom", "malware"), None),
)
#: Names that the NetFlow labels keep.
NETFLOW_NAMES = ("ddos", "dos", "reconnaissance", "theft", "injection", "password", "xss", "scanning", "backdoor", "mitm", "ransomware")


def attack_family(label: Column) -> Column:
    """Family of a raw attack label; null, empty and unknown texts are `other`."""
    x = F.replace(F.replace(F.lower(F.trim(label)), F.lit("_"), F.lit("-")), F.lit(" "), F.lit(""))
    out = F.when(x.isNull() | x.isin("", "nan", "none"), "other").when(x.contains("benign") | (x == "normal"), "benign")
    for family, parts, start in FAMILY_RULES:
        hit = contains_any(x, list(parts))
        out = out.when(hit | x.startswith(start) if start else hit, family)
    return out.otherwise("other")


def _snake(label: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(F.coalesce(label, F.lit("nan")))), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))


def unsw_family(label: Column) -> Column:
    x = _snake(label)
    return F.when(x.isin("normal", "benign"), "benign").when(x == "", "unknown").otherwise(x)


def netflow_family(label: Column) -> Column:
    x = _snake(label)
    return (
        F.when(x.isin("normal", "benign"), "benign").when(x.isin(*NETFLOW_NAMES), x).when(contains_any(x, ["scan", "recon"]), "reconnaissance").when(x.contains("ddos"), "ddos").when(x.startswith("dos"), "dos").when(x == "", "unknown").otherwise(x)
    )


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Probabilities of an array of logits at a temperature, shifted by the maximum."""
    t = F.greatest(F.lit(temperature) if not isinstance(temperature, Column) else temperature, F.lit(1e-6))
    bound = lambda x, f: F.transform(F.array(x), f)[0]
    powers = bound(F.array_max(logits), lambda m: F.transform(logits, lambda v: F.exp((v - m) / t)))
    return bound(powers, lambda e: bound(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda s: F.transform(e, lambda v: v / s)))


def argmax(values: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def linear_logits(features: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """x . w + b for a few classes as array expressions; weights: a row per feature."""
    out = []
    for k, b in enumerate(bias):
        w = F.array(*[F.lit(float(row[k])) for row in weights])
        out.append(F.aggregate(F.zip_with(features, w, lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v) + F.lit(float(b)))
    return F.array(*out)


def brier(p: Column, y: Column) -> Column:
    """Sum over classes of the squared distance to the one-hot label."""
    return F.aggregate(F.transform(p, lambda v, k: (v - F.when(k == y, 1.0).otherwise(0.0)) * (v - F.when(k == y, 1.0).otherwise(0.0))), F.lit(0.0), lambda a, v: a + v)


def nll(p: Column, y: Column) -> Column:
    return -F.ln(F.element_at(p, (y + 1).cast("int")) + 1e-12)


def ece_bin(confidence: Column, bins: int = 15) -> Column:
    """Equal bins, closed on the left, the last on both sides."""
    return F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")


def slug(c: Column) -> Column:
    """0.2 as 0p2, for file names."""
    return F.replace(c.cast("string"), F.lit("."), F.lit("p"))
