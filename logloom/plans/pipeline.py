"""The standard pipeline, from raw lines to enriched records and text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from logloom.operators.columns import demote_constant_fields
from logloom.operators.correlate import correlate
from logloom.operators.fold import fold, fold_islands
from logloom.operators.identity import MASK_RULES, identify
from logloom.operators.normalize import normalize
from logloom.operators.runs import fold_runs
from logloom.operators.severity import rerank_severity
from logloom.operators.stack import extract_stack
from logloom.operators.where import where
from logloom.sources.lines import MAX_LINE, split_long
from logloom.sources.materialize import materialize


@dataclass(frozen=True)
class Options:
    """What to do with the lines; the defaults do everything but filter.

    ``folding`` is "runs" (the exact stream fold), "islands" (the gap rule
    alone) or "" for none. With ``rejects``, a path, lines of ``max_line`` bytes
    or more are written there and left out; without it they are kept.
    """

    format: str = "auto"
    module: str = ""
    level: str = ""
    pattern: str = ""
    fields: Iterable[str] = field(default_factory=tuple)
    correlate: bool = True
    columns: bool = True
    folding: str = "islands"
    mask_rules: tuple[tuple[str, str], ...] = MASK_RULES
    max_line: int = MAX_LINE
    rejects: str = ""


def enrich(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """The per-line part: decode, re-rank, lift traces, filter, identify.

    No shuffle, and the same on a batch or a stream. The filter comes before
    everything that looks at neighbouring records, which thus sees shown ones.
    """
    records = extract_stack(rerank_severity(normalize(lines, options.format)), options.module)
    shown = where(records, options.level, options.pattern, options.fields)
    return identify(shown, options.mask_rules)


def run(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Enriched records with their groups, links, constant fields and repeats.

    The enriched records are written once; every neighbourhood operator reads
    only the narrow columns it needs, and the records take up the results by key.
    """
    if options.rejects:
        lines, long = split_long(lines, options.max_line)
        long.write.mode("overwrite").parquet(options.rejects)
    records = materialize(enrich(lines, options))
    out = records
    if options.correlate:
        out = correlate(out)
    if options.columns:
        out = demote_constant_fields(out, source=records)
    if options.folding == "runs":
        out = fold(out, fold_runs(records))
    elif options.folding == "islands":
        out = fold(out, fold_islands(records))
    elif options.folding:
        raise ValueError(f"unknown folding {options.folding!r}, want runs, islands or none")
    return out
