"""Weak-evidence hints, source gates and their randomised controls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import hash_order, number_of, q, to_double
from .quantiles import quantiles
from .sampling import distributed_row_number, hash_bucket, quota_thresholds, with_range

#: How far each source of evidence is trusted, by dataset family.
RELIABILITY = {
    "netflow": {"tcp": 0.90, "udp": 0.75, "icmp": 0.70, "bytes": 0.60, "packets": 0.60, "duration": 0.60, "flags": 0.70, "ports": 0.65},
    "unsw": {"tcp": 0.90, "udp": 0.75, "service": 0.70, "rate": 0.60, "flow": 0.60, "tcp_state": 0.70},
    "cic": {"tcp": 0.90, "udp": 0.75, "icmp": 0.70, "dns": 0.80, "http": 0.70, "arp": 0.65, "rate": 0.60, "flow": 0.60},
}
PREFIX = "_cti_"


@dataclass(frozen=True)
class Hint:
    """A 0/1 column: `rule` is equal, member, below, high (at or over the fitted quantile) or present; `columns` are
    tried in turn (the first that the table has), for `present` all are looked at."""

    name: str
    source: str
    rule: str
    columns: tuple[str, ...]
    value: object = None


#: The names of the hints, their sources and the columns that they look at, by dataset family.
NETFLOW_HINTS = (
    Hint("proto_tcp", "tcp", "equal", ("PROTOCOL",), 6), Hint("proto_udp", "udp", "equal", ("PROTOCOL",), 17), Hint("proto_icmp", "icmp", "equal", ("PROTOCOL",), 1),
    Hint("in_bytes_high", "bytes", "high", ("IN_BYTES",)), Hint("out_bytes_high", "bytes", "high", ("OUT_BYTES",)),
    Hint("in_pkts_high", "packets", "high", ("IN_PKTS",)), Hint("out_pkts_high", "packets", "high", ("OUT_PKTS",)),
    Hint("duration_high", "duration", "high", ("FLOW_DURATION_MILLISECONDS",)), Hint("tcp_flags_high", "flags", "high", ("TCP_FLAGS",)),
    Hint("src_port_low", "ports", "below", ("L4_SRC_PORT",), 1024), Hint("dst_port_low", "ports", "below", ("L4_DST_PORT",), 1024),
)
UNSW_HINTS = (
    Hint("proto_tcp", "tcp", "member", ("proto",), ("tcp",)), Hint("proto_udp", "udp", "member", ("proto",), ("udp",)),
    Hint("service_http", "service", "member", ("service",), ("http", "ssl", "ftp", "ftp-data")), Hint("service_dns", "service", "member", ("service",), ("dns",)),
    Hint("state_int", "tcp_state", "member", ("state",), ("int",)), Hint("state_fin", "tcp_state", "member", ("state",), ("fin",)),
    *(Hint(f"{c}_high", s, "high", (c,)) for c, s in (("rate", "rate"), ("sload", "rate"), ("dload", "rate"), ("sbytes", "flow"), ("dbytes", "flow"), ("tcprtt", "tcp"))),
)
CIC_HINTS = (
    *(Hint(f"{p}_present", p, "present", (p.upper(), f"{p}.*")) for p in ("tcp", "udp", "icmp", "dns")), Hint("http_present", "http", "present", ("HTTP", "HTTPS", "http.*")), Hint("arp_present", "arp", "present", ("ARP", "arp.*")),
    Hint("rate_high", "rate", "high", ("Rate", "Srate", "Drate")), Hint("flow_duration_high", "flow", "high", ("flow_duration", "Duration")), Hint("header_high", "flow", "high", ("Header_Length", "Tot size", "tcp.len")),
    Hint("syn_flag", "tcp", "high", ("syn_flag_number", "syn_count", "tcp.connection.syn")), Hint("rst_flag", "tcp", "high", ("rst_flag_number", "rst_count", "tcp.connection.rst")),
)


def first_number(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the named columns that the table has, null as 0; 0 if it has none."""
    for n in names:
        if n in df.columns:
            return F.coalesce(number_of(df, n), F.lit(0.0))
    return F.lit(0.0)


def present(df: DataFrame, names: tuple[str, ...]) -> Column:
    """Whether any named column (`x.*`: any that starts so) is a number other than 0 or a text that says something, as it
    stands: `0.00` and a blank do (P7)."""
    found = [c for n in names for c in df.columns if (c.lower().startswith(n[:-1].lower()) if n.endswith("*") else c == n)]
    hit = F.lit(False)
    for c in dict.fromkeys(found):
        number = F.abs(to_double(q(c))) > 1e-12
        text = ~F.lower(q(c).cast("string")).isin("", "0", "0.0", "nan", "none")
        hit = hit | F.coalesce(number, F.lit(False)) | F.coalesce(text, F.lit(False))
    return hit


def over_threshold(x: Column, threshold: Column | float) -> Column:
    """At or over the threshold; over 0 where that isn't positive (P10)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(t <= 0, x > 0).otherwise(x >= t)


def _high_columns(df: DataFrame, hints: tuple[Hint, ...]) -> dict[str, str | None]:
    return {h.name: next((c for c in h.columns if c in df.columns), None) for h in hints if h.rule == "high"}


def fit_limits(df: DataFrame, hints: tuple[Hint, ...], at: float = 0.75) -> dict[str, float]:
    """The quantile of each column that a `high` hint looks at, all by one selection."""
    columns = [c for c in dict.fromkeys(_high_columns(df, hints).values()) if c]
    return {c: v[0] or 0.0 for c, v in quantiles(df, {c: first_number(df, (c,)) for c in columns}, [at]).items()} if columns else {}


def add_hints(df: DataFrame, hints: tuple[Hint, ...], fit_on: Column | None = None, at: float = 0.75, limits: dict[str, float] | None = None) -> DataFrame:
    """df plus a 0/1 column per hint. Quantiles are fitted on the rows of `fit_on` (all without), unless `limits` has them,
    and become literals of the projection (J1)."""
    high = _high_columns(df, hints)
    if limits is None:
        limits = fit_limits(df if fit_on is None else df.where(fit_on), hints, at)

    def rule(h: Hint) -> Column:
        if h.rule == "equal":
            return first_number(df, h.columns) == F.lit(float(h.value))
        if h.rule == "below":
            return first_number(df, h.columns) < F.lit(float(h.value))
        if h.rule == "member":
            return F.lower(F.trim(q(h.columns[0]).cast("string"))).isin(*h.value) if h.columns[0] in df.columns else F.lit(False)
        if h.rule == "present":
            return present(df, h.columns)
        c = high[h.name]
        return over_threshold(first_number(df, (c,)), limits[c]) if c else F.lit(False)

    return df.withColumns({PREFIX + h.name: F.coalesce(rule(h), F.lit(False)).cast("double") for h in hints})


def add_gates(df: DataFrame, hints: tuple[Hint, ...], reliability: dict[str, float], pool: str = "sources") -> DataFrame:
    """df plus, for each source, its active count and gate, each hint times its source's gate, and the mean and maximum
    of the gates (P11); pool: `sources`, or `all` for the gated hints too."""
    by_source = {s: [h for h in hints if h.source == s] for s in reliability}
    new: dict[str, Column] = {}
    gates: list[Column] = []
    gated: list[Column] = []
    for s, own in by_source.items():
        if not own:
            continue
        active = sum((F.when(q(PREFIX + h.name) > 0, 1.0).otherwise(0.0) for h in own), F.lit(0.0))
        gate = F.lit(float(reliability[s])) * F.least(active / float(min(3, max(1, len(own)))), F.lit(1.0))
        new[f"{PREFIX}{s}_active_count"] = active
        new[f"{PREFIX}{s}_gate"] = gate
        gates.append(gate)
        for h in own:
            new[f"{PREFIX}{h.name}_source_gate"] = q(PREFIX + h.name) * gate
            gated.append(new[f"{PREFIX}{h.name}_source_gate"])
    pooled = gates + gated if pool == "all" else gates
    new[f"{PREFIX}source_gate_mean"] = sum(pooled, F.lit(0.0)) / len(pooled) if pooled else F.lit(0.0)
    new[f"{PREFIX}source_gate_max"] = F.array_max(F.array(*pooled)) if pooled else F.lit(0.0)
    return df.withColumns(new)


def permute_binary(df: DataFrame, columns: list[str], within: str, key: str, seed: int = 42) -> DataFrame:
    """Each 0/1 column shuffled on its own within the groups of `within` (H2): a shuffle of a 0/1 column is the choice
    of which rows are 1, so the ones go to the first rows in hash order. The thresholds of all columns are found
    together; the columns are then a projection. `within` has few groups (train, valid, test)."""
    ones = df.groupBy(q(within).cast("string").alias("w")).agg(*[F.sum((q(c) > 0).cast("long")).alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    quota = F.lit(0).cast("long")
    for r in ones:
        for i, c in enumerate(columns):
            quota = F.when(F.col("_g").eqNullSafe(F.concat_ws("|", F.lit(c), F.lit(r["w"]))), F.lit(r[f"c{i}"])).otherwise(quota)
    rows = df.select(q(within).cast("string").alias("w"), q(key).alias("_k"), F.explode(F.array(*[F.lit(c) for c in columns])).alias("c"))
    rows = rows.select(F.concat_ws("|", "c", "w").alias("_g"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("c"), F.col("_k").cast("string"))).alias("_h"), "_k")
    new = {c: F.lit(0.0) for c in columns}
    last = {g: (h, k) for g, h, k in quota_thresholds(rows, quota)}
    for r in ones:
        for c in columns:
            if at := last.get(f"{c}|{r['w']}" if r["w"] is not None else c):
                h = hash_order(seed, c, q(key))
                own = F.when((h < at[0]) | ((h == at[0]) & (q(key) <= at[1])), 1.0).otherwise(0.0)
                new[c] = F.when(q(within).cast("string").eqNullSafe(F.lit(r["w"])), own).otherwise(new[c])
    return df.withColumns(new)


def permute_column(df: DataFrame, column: str, within: str, key: str, seed: int = 42) -> DataFrame:
    """Any column shuffled within the groups of `within` (few: train, valid, test) by a rank join (J6). Both numberings are
    distributed: by key range and by hash prefix."""
    ranged, at = with_range(df, q(key), q(within))
    to = distributed_row_number(ranged, [q(key)], [q(within), *at], "_pos", within=1).drop("_range")
    h = hash_order(seed, column, q(key))
    source = distributed_row_number(df.select(q(within).alias("_w"), q(column).alias("_value"), h.alias("_h"), q(key).alias("_k")), [F.col("_h"), F.col("_k")], [F.col("_w"), hash_bucket(F.col("_h"))], "_from", within=1)
    return to.join(source, q(within).eqNullSafe(F.col("_w")) & (F.col("_pos") == F.col("_from"))).withColumn(column, F.col("_value")).drop("_w", "_value", "_from", "_pos", "_h", "_k")


MODES = ("traffic_only", "weak_cti_concat", "source_gate", "source_gate_pruned", "random_cti", "random_source_gate")


def evidence_modes(df: DataFrame, modes: tuple[str, ...], hints: tuple[Hint, ...], reliability: dict[str, float], within: str, key: str, fit_on: Column | None = None, pool: str = "sources", seed: int = 42) -> dict[str, DataFrame]:
    """df with the evidence columns of each mode (P12). Thresholds are fitted once and hints are shuffled once for all."""
    if unknown := set(modes) - set(MODES):
        raise ValueError(f"{sorted(unknown)} are none of {MODES}")
    names = [PREFIX + h.name for h in hints]
    evident = [m for m in modes if m != "traffic_only"]
    hinted = add_hints(df, hints, fit_on) if evident else df
    base = {False: hinted, True: permute_binary(hinted, names, within, key, seed) if any(m.startswith("random") for m in evident) else hinted}
    out = {m: df for m in modes if m == "traffic_only"}
    for m in evident:
        own = base[m.startswith("random")]
        own = add_gates(own, hints, reliability, pool) if "source_gate" in m else own
        out[m] = own.drop(*names) if m == "source_gate_pruned" else own
    return {m: out[m] for m in modes}


def evidence_mode(df: DataFrame, mode: str, hints: tuple[Hint, ...], reliability: dict[str, float], within: str, key: str, fit_on: Column | None = None, pool: str = "sources", seed: int = 42) -> DataFrame:
    """df with the evidence columns of one mode."""
    return evidence_modes(df, (mode,), hints, reliability, within, key, fit_on, pool, seed)[mode]


def scale_evidence(features: Column, names: list[str], alpha: float) -> Column:
    """A feature array with its evidence entries times alpha."""
    mask = F.array(*[F.lit(alpha if n.startswith(PREFIX) else 1.0) for n in names])
    return F.zip_with(features, mask, lambda v, m: v * m)


def poison_evidence(df: DataFrame, columns: list[str], share: float, within: str, key: str, seed: int = 42) -> DataFrame:
    """On a share of the rows, chosen by hash, the evidence columns are those of another chosen row of the same group."""
    chosen = F.conv(F.substring(hash_order(seed, "poison", q(key)), 1, 8), 16, 10).cast("double") < share * float(1 << 32)
    marked = df.withColumn("_row", F.struct(*[q(c).alias(f"c{i}") for i, c in enumerate(columns)])).withColumn("_group", F.when(chosen, F.coalesce(q(within).cast("string"), F.lit(""))))
    moved = permute_column(marked.where("_group IS NOT NULL"), "_row", "_group", key, seed)
    moved = moved.withColumns({c: F.col(f"_row.c{i}") for i, c in enumerate(columns)})
    return marked.where("_group IS NULL").unionByName(moved).drop("_row", "_group")


def drop_evidence(df: DataFrame, columns: list[str], share: float, key: str, seed: int = 42) -> DataFrame:
    """Evidence columns set to 0 on a share of the rows, chosen by hash."""
    chosen = F.conv(F.substring(hash_order(seed, "dropout", q(key)), 1, 8), 16, 10).cast("double") < share * float(1 << 32)
    return df.withColumns({c: F.when(chosen, 0.0).otherwise(q(c)) for c in columns})
