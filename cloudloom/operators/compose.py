"""Blend folds of effects over points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import scalar as S

MODES = ("add", "max", "multiply", "screen", "override")
#: Effects this weak are skipped.
LEAST_VALUE = 1e-6
_ADDS = ("emission", "opacity", "size")
_STATE = ("value", *_ADDS, "opacity_mul", "size_mul", "mix", "red", "green", "blue", "sum_red", "sum_green", "sum_blue", "weight")


def screen(a: Column, b: Column) -> Column:
    return 1.0 - (1.0 - S.clamp(a)) * (1.0 - S.clamp(b))


def _pick(mode: Column, **by_mode: Column) -> Column:
    out = by_mode["add"]
    for m in MODES[1:]:
        out = F.when(mode == m, by_mode[m]).otherwise(out)
    return out


def _step(s: Column, e: Column) -> Column:
    mode, v = e["mode"], e["value"]
    new = {"value": _pick(mode, add=S.clamp(s["value"] + v), max=F.greatest(s["value"], v), multiply=F.greatest(s["value"], v), screen=screen(s["value"], v), override=v)}
    for c in _ADDS:
        both = s[c] + e[c]
        new[c] = _pick(mode, add=both, max=F.greatest(s[c], e[c]), multiply=both, screen=screen(s[c], e[c]), override=e[c])
    for c in ("opacity_mul", "size_mul"):
        both = s[c] * e[c]
        new[c] = _pick(mode, add=both, max=F.greatest(s[c], e[c]), multiply=both, screen=both, override=e[c])
    both = S.clamp(s["mix"] + e["mix"])
    new["mix"] = _pick(mode, add=both, max=F.greatest(s["mix"], e["mix"]), multiply=both, screen=screen(s["mix"], e["mix"]), override=e["mix"])
    replaces = (mode == "override") | ((mode == "max") & (e["mix"] >= s["mix"]))
    tints = mode.isin("add", "multiply", "screen") & (e["mix"] > LEAST_VALUE)
    for c in ("red", "green", "blue"):
        new[c] = F.when(replaces, e[c]).otherwise(s[c])
        new[f"sum_{c}"] = F.when(tints, s[f"sum_{c}"] + e[c] * S.clamp(e["mix"])).otherwise(s[f"sum_{c}"])
    # An override forgets the weight of the tints before it but not their sums; a later tint mixes with those.
    new["weight"] = F.when(mode == "override", 0.0).when(tints, s["weight"] + S.clamp(e["mix"])).otherwise(s["weight"])
    return F.struct(*[new[c].cast("double").alias(c) for c in _STATE])


def _start() -> Column:
    return F.struct(*[F.lit(1.0 if c.endswith("_mul") else 0.0).alias(c) for c in _STATE])


def compose(effects: DataFrame) -> DataFrame:
    """The ordered fold of each point's effects.

    effects: point_index, order, mode, value, emission, opacity, size, opacity_mul, size_mul, mix, red, green, blue.
    Modes do not commute, so a point's effects are brought together in ``order``; there are as many as layers that overlap there.
    """
    fields = ("mode", "value", *_ADDS, "opacity_mul", "size_mul", "mix", "red", "green", "blue")
    ready = effects.withColumn("value", S.clamp(F.col("value"))).where(F.col("value") > LEAST_VALUE)
    grouped = ready.groupBy("point_index").agg(F.array_sort(F.collect_list(F.struct("order", *fields))).alias("effects"))
    out = grouped.select("point_index", F.aggregate("effects", _start(), _step).alias("s"))
    tint = lambda c: F.when(F.col("s.weight") > LEAST_VALUE, F.col(f"s.sum_{c}") / F.col("s.weight")).otherwise(F.col(f"s.{c}")).alias(c)
    plain = [F.col(f"s.{c}").alias(c) for c in ("value", *_ADDS)]
    muls = [F.greatest(F.col(f"s.{c}"), F.lit(0.0)).alias(c) for c in ("opacity_mul", "size_mul")]
    return out.select("point_index", *plain, *muls, F.col("s.mix").alias("mix"), *[tint(c) for c in ("red", "green", "blue")])


def compose_uniform(effects: DataFrame, mode: str) -> DataFrame:
    """A19 where all effects are of one commutative mode: plain aggregates with partial sums, no order and no lists."""
    ready = effects.withColumn("value", S.clamp(F.col("value"))).where(F.col("value") > LEAST_VALUE)
    if mode == "max":
        return ready.groupBy("point_index").agg(F.max("value").alias("value"), *[F.greatest(F.max(c), F.lit(0.0)).alias(c) for c in _ADDS])
    if mode == "screen":
        left = lambda c: 1.0 - F.product(1.0 - S.clamp(F.col(c)))
        return ready.groupBy("point_index").agg(left("value").alias("value"), *[left(c).alias(c) for c in _ADDS])
    if mode == "add":
        return ready.groupBy("point_index").agg(F.least(F.lit(1.0), F.sum("value")).alias("value"), *[F.sum(c).alias(c) for c in _ADDS])
    raise ValueError("only add, max and screen commute")


def compose_members(contributions: DataFrame) -> DataFrame:
    """The same fold over sparse memberships; colours of add, multiply and screen are mixed one after the other."""

    def step(s: Column, e: Column) -> Column:
        base = _step(s, e)
        share = F.when(base["mix"] > LEAST_VALUE, e["mix"] / base["mix"]).otherwise(0.0)
        progressive = e["mode"].isin("add", "multiply", "screen")
        return F.struct(*[(F.when(progressive, S.lerp(s[c], e[c], S.clamp(share))).otherwise(base[c]) if c in ("red", "green", "blue") else F.lit(0.0) if c == "weight" else base[c]).cast("double").alias(c) for c in _STATE])

    fields = ("mode", "value", *_ADDS, "opacity_mul", "size_mul", "mix", "red", "green", "blue")
    ready = contributions.withColumn("value", S.clamp(F.col("value"))).where(F.col("value") > LEAST_VALUE)
    grouped = ready.groupBy("point_index").agg(F.array_sort(F.collect_list(F.struct("order", *fields))).alias("effects"))
    out = grouped.select("point_index", F.aggregate("effects", _start(), step).alias("s"))
    return out.select("point_index", *[F.col(f"s.{c}").alias(c) for c in ("value", *_ADDS, "opacity_mul", "size_mul", "mix", "red", "green", "blue")])


def runtime_params(layers: Sequence[dict]) -> list[dict]:
    """The dimension: a row of parameters for each layer, numbered by param_index."""
    return [{"param_index": i, **layer} for i, layer in enumerate(layers)]


def contribute(members: DataFrame, params: DataFrame, t: float, pattern: Column) -> DataFrame:
    """What each membership (point_index, param_index, edge_weight) gives at time t.

    params is the small dimension (intensity, emission, opacity, size, mix, mode, speed, phase); changing it, or t, touches no membership.
    ``pattern`` is the pattern's value as a column of (members, params, phase_t).  A lace ignores the edge weight.
    """
    both = members.join(params, "param_index").withColumn("phase_t", F.col("phase") - F.lit(float(t)) * F.col("speed"))
    edge = F.when(F.col("pattern") == "caustic_lace", 1.0).otherwise(F.col("edge_weight"))
    value = S.clamp(pattern * F.col("intensity") * edge)
    return both.withColumn("value", value).withColumns({c: F.col("value") * F.col(f"{c}_response") for c in (*_ADDS, "mix")})


def response(value: Column, at_zero: float, at_one: float) -> Column:
    """A hint between two settings by the pattern's value."""
    return S.lerp(at_zero, at_one, S.clamp(value))
