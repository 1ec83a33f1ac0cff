"""The projection that an export writes: mapped, unmapped and summed channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid import units
from tracegrid.operators.resample import sum_channels


def project(samples: DataFrame, mapping: list[tuple[str, str, str]] = (), include_unmapped: bool = True, exclude: list[str] = (), sums: list[list[str]] = ()) -> DataFrame:
    """Long samples as an export has them; a changed channel is stored as float64.

    ``mapping``: [source, target, unit]; the unit text of the source converts to
    it by the registry.  ``exclude`` drops channels, ``sums`` are [target, source,
    source...] on equal clocks and units.  Faults in the request raise at once.
    """
    targets = [t.lower() for _, t, _ in mapping] + [s[0].lower() for s in sums]
    if any(not t.strip() for t in targets) or len(set(targets)) != len(targets):
        raise ValueError("empty or repeated target channel")
    gone = [x.lower() for x in exclude]
    name = F.lower("channel")
    parts = []
    for source, target, unit in mapping:
        s = samples.where(name == source.lower())
        value = units.convert_units(F.col("value"), F.coalesce(F.nullif("unit", F.lit("")), F.lit(unit)), F.lit(unit)) if unit else F.col("value")
        parts.append(s.withColumns({"channel": F.lit(target), "value": value, "unit": F.lit(unit) if unit else F.col("unit")}))
    if include_unmapped:
        parts.append(samples.where(~name.isin([m[0].lower() for m in mapping] + gone or [""])))
    for target, *sources in sums:
        parts.append(sum_channels(samples, sources, target))
    if not parts:
        raise ValueError("nothing to export")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
