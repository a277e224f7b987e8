"""Small tables as LaTeX, Markdown and review packets. A report's rows are collected, so their number is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame

MAX_ROWS = 5_000
# LaTeX's special characters.
_TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def tex(value: object) -> str:
    """A value as LaTeX text."""
    return "" if value is None else "".join(_TEX.get(c, c) for c in str(value))


def rows_of(df: DataFrame, limit: int = MAX_ROWS) -> list:
    """A small table's rows; more than ``limit`` are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows: write a table instead")
    return rows


def _cell(v: object, digits: int) -> str:
    return f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)


def latex(df: DataFrame, digits: int = 3) -> str:
    """A small table as LaTeX."""
    head = " & ".join(tex(c) for c in df.columns)
    body = [" & ".join(tex(_cell(v, digits)) for v in r) + r" \\" for r in rows_of(df)]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", head + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"]) + "\n"


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A small table as Markdown."""
    line = lambda cells: "| " + " | ".join(c.replace("|", r"\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line([_cell(v, digits) for v in r]) for r in rows_of(df)]]) + "\n"


def quoted(text: str | None) -> str:
    """A text as a Markdown quotation."""
    return "\n".join("> " + x for x in (text or "[Not available]").splitlines())


def review_packet(df: DataFrame, title: str, ident: str, sections: dict[str, str], questions: list[str]) -> str:
    """One section a record: its texts quoted, then a line for each question."""
    out = [f"# {title}"]
    for r in rows_of(df):
        parts = [f"## {r[ident]}", *[f"**{name}**\n\n{quoted(r[c])}" for name, c in sections.items()], "\n".join(f"- {q}: " for q in questions)]
        out.append("\n\n".join(parts))
    return "\n\n".join(out) + "\n"
