"""Channel maps: opt-in renaming, relabelling and affine conversion of channels.

One rule a line (or between semicolons): ``source -> target [unit] * scale + offset``;
everything after the arrow but the target is optional, ``#`` starts a comment.
"""

from __future__ import annotations

import math
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAIL = re.compile(r"^(?:\*\s*(?P<scale>\S+?))?\s*(?:(?P<sign>[+-])\s*(?P<offset>\S+))?$")


class MapError(ValueError):
    pass


@dataclass(frozen=True)
class ChannelRule:
    source: str
    target: str
    unit: str | None = None
    scale: float = 1.0
    offset: float = 0.0

    @property
    def identity(self) -> bool:
        return self.scale == 1.0 and self.offset == 0.0


def _number(text: str, line: int, what: str) -> float:
    try:
        x = float(text)
    except ValueError:
        raise MapError(f"line {line}: {what} {text!r} is no number") from None
    if not math.isfinite(x):
        raise MapError(f"line {line}: {what} must be finite")
    return x


def parse_map(text: str) -> list[ChannelRule]:
    """The rules of a map text; a ``MapError`` names the line of the first fault."""
    rules: list[ChannelRule] = []
    sources: set[str] = set()
    targets: set[str] = set()
    for number, line in enumerate(text.splitlines(), 1):
        for part in line.split("#", 1)[0].split(";"):
            if not part.strip():
                continue
            source, arrow, rest = part.partition("->")
            if not arrow or not source.strip():
                raise MapError(f"line {number}: expected 'source -> target'")
            rest, unit = rest.strip(), None
            if "[" in rest:
                target, rest = rest.split("[", 1)
                if "]" not in rest:
                    raise MapError(f"line {number}: '[' is not closed")
                unit, rest = (x.strip() for x in rest.split("]", 1))
            else:
                cut = re.search(r"\s[*+]\s|\s-\s", rest)
                target, rest = (rest[: cut.start()], rest[cut.start() :].strip()) if cut else (rest, "")
            tail = _TAIL.match(rest.strip())
            if not target.strip() or not tail:
                raise MapError(f"line {number}: cannot read {part.strip()!r}")
            scale = _number(tail["scale"], number, "scale") if tail["scale"] else 1.0
            offset = _number(tail["offset"], number, "offset") * (-1 if tail["sign"] == "-" else 1) if tail["offset"] else 0.0
            if scale == 0:
                raise MapError(f"line {number}: scale must not be 0")
            rule = ChannelRule(source.strip(), target.strip(), unit or None, scale, offset)
            for seen, name, what in ((sources, rule.source, "source"), (targets, rule.target, "target")):
                if name.lower() in seen:
                    raise MapError(f"line {number}: {what} {name!r} stands twice")
                seen.add(name.lower())
            rules.append(rule)
    return rules


def load_map(text_or_path: str) -> list[ChannelRule]:
    """A map from inline text or, if there is no arrow in it and such a file exists, from a file."""
    if "->" not in text_or_path and os.path.isfile(text_or_path):
        with open(text_or_path, encoding="utf-8") as f:
            return parse_map(f.read())
    return parse_map(text_or_path)


def validate_map(rules: list[ChannelRule], available: list[str]) -> None:
    """Every source must be an available channel, without regard to case."""
    have = {a.lower() for a in available}
    missing = [r.source for r in rules if r.source.lower() not in have]
    if missing:
        raise MapError(f"channels not found: {', '.join(missing)}")


def apply_map(samples: DataFrame, rules: list[ChannelRule], channel: str = "channel", value: str | None = "value") -> DataFrame:
    """Renames, relabels and converts; channels without a rule stay as they are.

    The rules become one constant map from source name to rule, so that the plan
    has neither a join nor a Python function.
    """
    if not rules:
        return samples
    rule = F.create_map(*[x for r in rules for x in (F.lit(r.source.lower()), F.struct(F.lit(r.target).alias("target"), F.lit(r.unit).cast("string").alias("unit"), F.lit(r.scale).alias("scale"), F.lit(r.offset).alias("offset")))])
    out = samples.withColumn("__rule", F.try_element_at(rule, F.lower(F.col(channel))))
    hit = F.col("__rule")
    changed = {channel: F.coalesce(hit.target, F.col(channel)), "unit": F.coalesce(hit.unit, F.col("unit"))}
    if "unit_source" in samples.columns:
        changed["unit_source"] = F.when(hit.unit.isNotNull(), "declared").otherwise(F.col("unit_source"))
    if value:
        changed[value] = F.when(hit.isNotNull(), F.col(value) * hit.scale + hit.offset).otherwise(F.col(value))
    return out.withColumns(changed).drop("__rule")


def rule_text(name: str, target: str, unit: str | None, scale: float = 1.0, offset: float = 0.0) -> str:
    """The rule that ``parse_map`` reads back."""
    return f"{name} -> {target}" + (f" [{unit}]" if unit else "") + (f" * {scale!r}" if scale != 1 else "") + (f" {'+' if offset > 0 else '-'} {abs(offset)!r}" if offset else "")


def recovered_map(channels: DataFrame) -> DataFrame:
    """(file, map): the map text that names every channel of a file as it is, in file order; channel lists are bounded by the formats."""
    unit = F.coalesce("unit", F.lit(""))
    rule = F.concat("name", F.lit(" -> "), "name", F.when(unit != "", F.concat(F.lit(" ["), unit, F.lit("]"))).otherwise(""))
    g = channels.where("name is not null").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("channel_id", rule.alias("rule")))).alias("rules"))
    return g.select("file", F.array_join(F.transform("rules", lambda x: x["rule"]), "; ").alias("map"))
