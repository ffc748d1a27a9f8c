"""Small result tables as text: Markdown, LaTeX, JSON. Span exporters that do nothing unless a library is there."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1000


def _rows(df: DataFrame, limit: int) -> tuple[list[str], list[list]]:
    return df.columns, [list(r) for r in df.limit(limit).collect()]


def _text(v, digits: int) -> str:
    return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def to_markdown(df: DataFrame, digits: int = 3, limit: int = LIMIT) -> str:
    names, rows = _rows(df, limit)
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *[line([_text(v, digits) for v in r]) for r in rows]])


def to_latex(df: DataFrame, digits: int = 3, limit: int = LIMIT) -> str:
    names, rows = _rows(df, limit)
    esc = lambda s: s.replace("_", r"\_").replace("&", r"\&").replace("%", r"\%")
    body = [" & ".join(esc(_text(v, digits)) for v in r) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(names) + "}", r"\hline", " & ".join(map(esc, names)) + r" \\", r"\hline", *body, r"\hline", r"\end{tabular}"])


def to_json(df: DataFrame, limit: int = LIMIT) -> str:
    names, rows = _rows(df, limit)
    return json.dumps([dict(zip(names, r, strict=True)) for r in rows], default=str, ensure_ascii=False)


class NullExporter:
    """Takes spans and drops them."""

    def export(self, name: str, **attributes) -> None:
        del name, attributes

    @contextmanager
    def span(self, name: str, **attributes):
        began = time.time()
        yield
        self.export(name, seconds=time.time() - began, **attributes)


class ListExporter(NullExporter):
    """Keeps spans in memory."""

    def __init__(self):
        self.spans: list[dict] = []

    def export(self, name: str, **attributes) -> None:
        self.spans.append({"name": name, **attributes})


class OtlpExporter(NullExporter):
    def __init__(self):
        from opentelemetry import trace

        self.tracer = trace.get_tracer("ponderloom")

    def export(self, name: str, **attributes) -> None:
        with self.tracer.start_as_current_span(name) as s:
            for k, v in attributes.items():
                s.set_attribute(k, v)


class LangfuseExporter(NullExporter):
    def __init__(self):
        from langfuse import Langfuse

        self.client = Langfuse()

    def export(self, name: str, **attributes) -> None:
        self.client.create_event(name=name, metadata=attributes)


KINDS = {"null": NullExporter, "list": ListExporter, "otlp": OtlpExporter, "langfuse": LangfuseExporter}


def make_exporter(kind: str = "null") -> NullExporter:
    """null, list, otlp or langfuse; a kind that is unknown, or whose library isn't installed, falls back to null."""
    try:
        return KINDS.get(kind, NullExporter)()
    except ImportError:
        return NullExporter()


# Summaries of results, a few lines each


def _lines(title: str, pairs) -> str:
    shown = [(str(k), _text(v, 3)) for k, v in pairs]
    width = max((len(k) for k, _ in shown), default=0)
    return "\n".join([title, *[f"  {k:<{width}}  {v}" for k, v in shown]])


def describe_row(df: DataFrame, title: str) -> str:
    """A table of one row (a decision, a gold score, a threshold): a line for each column."""
    row = df.first()
    return _lines(title, row.asDict().items() if row else [])


def describe_rules(violations: DataFrame, title: str = "Violations") -> str:
    """Violations (rule, failure_mode): how many of each, and in how many traces."""
    n = violations.groupBy("rule", "failure_mode").agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("traces")).orderBy(F.desc("n"), "rule", "failure_mode")
    return _lines(title, [(f"{r['rule']} {r['failure_mode']}", f"{r['n']} in {r['traces']} traces") for r in n.limit(LIMIT).collect()])


def describe_pruning(report: DataFrame, title: str = "Redundancy") -> str:
    """prune.report's rows: traces, those with regions, tokens saved and their range."""
    s = report.agg(F.count("*").alias("traces"), F.sum((F.col("n_regions") > 0).cast("long")).alias("with_regions"), *[F.sum(c).alias(c) for c in ("n_regions", "savings", "savings_low", "savings_high")])
    return describe_row(s, title)
