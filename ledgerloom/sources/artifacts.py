"""Small, byte-reproducible result files: CSV, JSON and Markdown, written all or not at all.

These files are reports with a bounded number of rows; large results are written by Spark's own writers.
"""

from __future__ import annotations

import csv
import fcntl
import hashlib
import html
import io
import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame

MOST_BYTES = 32 * 1024 * 1024
_FORMULA = re.compile(r"^[\s\x00-\x20\x85\xa0]*[=+\-@]")
_BIDI = re.compile("[؜‎‏‪-‮⁦-⁩]")


def safe_cell(value: object) -> str:
    """A CSV cell that isn't taken for a formula; lists joined by `;`, nulls empty."""
    text = "" if value is None else ";".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)
    return "'" + text if _FORMULA.match(text) else text


def render_csv(columns: list[str], rows: Iterable[Iterable[object]]) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    for row in rows:
        writer.writerow([safe_cell(v) for v in row])
        if out.tell() > MOST_BYTES:
            raise ValueError("the report is larger than a report may be")
    return out.getvalue()


def render_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def escape_markdown(text: str) -> str:
    """Text that shows as itself: HTML and Markdown signs escaped, direction marks written out."""
    text = _BIDI.sub(lambda m: f"\\u{ord(m[0]):04x}", html.escape(text, quote=False))
    return re.sub(r"([\\`*_{}\[\]()#+\-!|])", r"\\\1", text)


def render_table(columns: list[str], rows: Iterable[Iterable[object]]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(escape_markdown("" if v is None else str(v)) for v in row) + " |" for row in rows]
    return "\n".join(lines) + "\n"


@contextmanager
def exclusive(folder: str):
    """Holds a folder's lock; fails at once if another process has it."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, ".lock"), "w") as handle:
        fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
        yield


def write_artifacts(folder: str, contents: dict[str, str]) -> dict[str, str]:
    """Writes a set of files as a whole and returns their hashes. They are staged beside the folder and swapped in, the old set is kept until then;
    a set left by an interrupted swap is put back first."""
    folder = folder.rstrip("/")
    parent = os.path.dirname(folder) or "."
    os.makedirs(parent, exist_ok=True)
    old = folder + ".old"
    with exclusive(folder + ".guard"):
        if os.path.isdir(old):
            if os.path.isdir(folder):
                shutil.rmtree(old)
            else:
                os.rename(old, folder)
        stage = tempfile.mkdtemp(prefix=os.path.basename(folder) + ".", dir=parent)
        for name, text in contents.items():
            data = text.encode("utf-8")
            if len(data) > MOST_BYTES or os.path.basename(name) != name:
                shutil.rmtree(stage)
                raise ValueError(f"can't write {name}")
            with open(os.path.join(stage, name), "wb") as out:
                out.write(data)
                out.flush()
                os.fsync(out.fileno())
        if os.path.isdir(folder):
            os.rename(folder, old)
        os.rename(stage, folder)
        shutil.rmtree(old, ignore_errors=True)
    return {name: hashlib.sha256(text.encode("utf-8")).hexdigest() for name, text in contents.items()}


def compare_artifacts(folder: str, contents: dict[str, str]) -> dict[str, str]:
    """name -> `missing`, `extra` or `modified` for the files that aren't as they should be."""
    actual = {n for n in (os.listdir(folder) if os.path.isdir(folder) else []) if os.path.isfile(os.path.join(folder, n))}
    out = {n: "missing" for n in contents if n not in actual} | {n: "extra" for n in actual if n not in contents}
    for name in actual & set(contents):
        with open(os.path.join(folder, name), "rb") as handle:
            if handle.read() != contents[name].encode("utf-8"):
                out[name] = "modified"
    return out


def report_rows(df: DataFrame, order: list[str], most: int = 10_000) -> list[tuple]:
    """The rows of a report in order; more than `most` is an error, not a cut."""
    rows = [tuple(r) for r in df.orderBy(*order).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return rows
