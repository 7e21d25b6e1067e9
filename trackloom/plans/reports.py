"""Small results as Markdown: tables, and files in which a marked block is replaced."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

MOST_ROWS = 1_000


def markdown(df: DataFrame, most: int = MOST_ROWS) -> str:
    """A report's rows as a table. A report is small: more than ``most`` rows are an error, not cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["-"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)


def replace_block(path: str | Path, name: str, text: str) -> None:
    """Puts ``text`` between the marks of block ``name`` in a file; a file without them gets them at its end."""
    path = Path(path)
    begin, end = f"<!-- begin {name} -->", f"<!-- end {name} -->"
    block = f"{begin}\n{text}\n{end}"
    old = path.read_text() if path.exists() else ""
    if begin in old and end in old:
        head, _, rest = old.partition(begin)
        new = head + block + rest.partition(end)[2]
    else:
        new = (old.rstrip("\n") + "\n\n" if old.strip() else "") + block + "\n"
    path.write_text(new)
