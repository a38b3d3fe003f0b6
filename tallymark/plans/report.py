"""A report of a chain as Markdown and HTML, from its small result tables."""

from __future__ import annotations

import html
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.monitoring import Monitor
from .chain import Chain

MAX_ROWS = 30


def table(columns: list[str], rows: list[tuple], at_most: int = MAX_ROWS) -> str:
    """A Markdown table; bars in cells are escaped, and rows left out are counted."""
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(map(cell, columns))} |", f"|{'---|' * len(columns)}", *(f"| {' | '.join(map(cell, r))} |" for r in rows[:at_most])]
    if len(rows) > at_most:
        lines.append(f"\n{len(rows) - at_most} more rows")
    return "\n".join(lines)


def to_html(text: str) -> str:
    """Headings, paragraphs, lists and tables of the Markdown that this module writes."""
    out, held, kind = [], [], ""

    def close() -> None:
        nonlocal held, kind
        if kind == "table":
            rows = [[c.strip().replace("\\|", "|") for c in line.strip("|").replace("\\|", "\0").split("|")] for line in held]
            cells = lambda r, tag: "".join(f"<{tag}>{html.escape(c.replace(chr(0), '|'))}</{tag}>" for c in r)
            out.append("<table>" + f"<tr>{cells(rows[0], 'th')}</tr>" + "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows[2:]) + "</table>")
        elif kind == "list":
            out.append("<ul>" + "".join(f"<li>{html.escape(x[2:])}</li>" for x in held) + "</ul>")
        held, kind = [], ""

    for line in text.split("\n"):
        new = "table" if line.startswith("|") else "list" if line.startswith("- ") else ""
        if new != kind:
            close()
        if new:
            kind = new
            held.append(line)
        elif line.startswith("#"):
            level = len(line) - len(line.lstrip("#"))
            out.append(f"<h{level}>{html.escape(line[level:].strip())}</h{level}>")
        elif line.strip():
            out.append(f"<p>{html.escape(line)}</p>")
    close()
    return "<!DOCTYPE html><html><head><meta charset='utf-8'></head><body>" + "\n".join(out) + "</body></html>"


@dataclass
class Report:
    title: str
    sections: list[tuple[str, str]] = field(default_factory=list)

    def add(self, title: str, body: str) -> Report:
        self.sections.append((title, body))
        return self

    def add_frame(self, title: str, df: DataFrame | None, at_most: int = MAX_ROWS) -> Report:
        """A small DataFrame; one row more than is shown is fetched."""
        if df is None:
            return self
        rows = [tuple(r) for r in df.limit(at_most + 1).collect()]
        return self.add(title, table(df.columns, rows, at_most))

    def add_monitor(self, monitor: Monitor) -> Report:
        rows = [(s.period, s.n, s.ks, s.psi_score, s.status, s.recommendation) for s in monitor.snapshots]
        return self.add("Monitoring", table(["period", "n", "ks", "psi_score", "status", "recommendation"], rows))

    @classmethod
    def of(cls, chain: Chain, title: str = "scorecard", stability: DataFrame | None = None, periods: DataFrame | None = None, monitor: Monitor | None = None) -> Report:
        out, e = cls(title), chain.evaluation_ or {}
        ks, psi = e.get("test_ks", e.get("trn_ks")), e.get("psi")
        words = []
        if chain.halted:
            words.append(f"- halted: {chain.halt_message}")
        if ks is not None:
            words.append(f"- KS {ks:.4f}: {'good' if ks > 0.4 else 'fair' if ks > 0.25 else 'weak'}")
        if psi is not None:
            words.append(f"- PSI {psi:.4f}: {'stable' if psi < 0.1 else 'slight drift' if psi < 0.25 else 'drift'}")
        out.add("Overview", "\n".join([f"- features: {', '.join(chain.support)}", *words]))
        out.add_frame("Columns", chain.detect_).add_frame("Single-column quality", chain.quality_)
        if chain.tables:
            for t in list(chain.tables.values())[:10]:
                rows = [(b.label, b.bad + b.good, b.bad, b.woe, b.iv) for b in t.bins]
                out.add(f"Bins of {t.variable} (IV {t.iv_total:.4f})", table(["bin", "count", "bad", "woe", "iv"], rows))
        out.add_frame("Stability", stability)
        for name, found in (("Screening of raw features", chain.prefilter_), ("Screening of binned features", chain.refine_)):
            out.add_frame(name, found.quality if found else None)
        if chain.selector_:
            rows = [(r[0], r[1], r[3], r[4]) for r in chain.selector_.record]
            out.add("Selection", table(["round", "features", "score", "passed"], rows, 15))
        if chain.model_:
            rows = [("const", chain.model_.intercept, None), *((c, v, chain.model_.p_values[c]) for c, v in chain.model_.coef.items())]
            out.add("Model", table(["feature", "coefficient", "p"], rows))
        if e:
            out.add("Evaluation", table(["metric", "value"], [(k, v) for k, v in e.items() if isinstance(v, (int, float))]))
            out.add_frame("Score table", e.get("score_table"))
        out.add_frame("Periods", periods)
        if monitor:
            out.add_monitor(monitor)
        if chain.rules_:
            out.add("Rules", table(["rule", "hits", "bad", "lift"], [(r.text, r.hit, r.bad, r.lift) for r in chain.rules_]))
        if chain.diagnosis_ is not None:
            out.add("Diagnosis", "\n".join(f"- {line}" for line in str(chain.diagnosis_).split("\n")))
        return out

    def build(self) -> str:
        return f"# {self.title}\n" + "".join(f"\n## {name}\n\n{body}\n" for name, body in self.sections)

    def save(self, path: str, write_html: bool = True) -> None:
        """A Markdown file at path and, beside it, the same as HTML."""
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        text = self.build()
        with open(path, "w") as file:
            file.write(text)
        if write_html:
            with open(os.path.splitext(path)[0] + ".html", "w") as file:
                file.write(to_html(text))
