"""Reports of an audit as text: cited records, a Markdown report, JSON with the hashes of its files, and lines for a terminal.

They are made of bounded, ordered rows (artifacts.report_rows()) on the driver.
"""

from __future__ import annotations

import hashlib
import html
import os
import stat
from collections.abc import Iterable, Mapping
from urllib.parse import quote

from ledgerloom.functions.text import label_of
from ledgerloom.sources.artifacts import MOST_BYTES, escape_markdown, render_csv, render_json, render_table

# Signs that a terminal may take for orders, or that turn the direction of writing.
_UNSAFE = {*range(0x20), *range(0x7F, 0xA0), 0x61C, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)}


class UnsafeFile(ValueError):
    """Why a file isn't read or written."""


def read_stable(path: str, most_bytes: int) -> bytes:
    """The bytes of a regular file that is no link, isn't larger than allowed, and is the same file with the same size and times after it was read."""
    if os.path.islink(path) or os.path.islink(os.path.dirname(path) or "."):
        raise UnsafeFile("link")
    try:
        handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_CLOEXEC)
    except FileNotFoundError:
        raise UnsafeFile("missing") from None
    except OSError:
        raise UnsafeFile("unsafe") from None
    with os.fdopen(handle, "rb") as file:
        state = lambda s: (s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns, s.st_ctime_ns)
        before = os.fstat(handle)
        if not stat.S_ISREG(before.st_mode):
            raise UnsafeFile("not_regular")
        data = file.read(most_bytes + 1) if before.st_size <= most_bytes else None
        if data is None or len(data) > most_bytes:
            raise UnsafeFile("too_large")
        try:
            after = os.stat(path, follow_symlinks=False)
        except FileNotFoundError:
            raise UnsafeFile("changed") from None
        if state(os.fstat(handle)) != state(before) or state(after) != state(before):
            raise UnsafeFile("changed")
    return data


def new_file(path: str, data: str, apart_from: Iterable[str] = ()) -> None:
    """Writes a file that must not exist yet, outside the folders named and none that holds one of them."""
    own = os.path.realpath(path)
    for folder in map(os.path.realpath, apart_from):
        if os.path.commonpath([own, folder]) in (own, folder):
            raise UnsafeFile("overlap")
    os.makedirs(os.path.dirname(own), exist_ok=True)
    try:
        with open(path, "x", encoding="utf-8", newline="\n") as out:
            out.write(data)
    except FileExistsError:
        raise UnsafeFile("exists") from None


def terminal_safe(text: object, encoding: str = "utf-8") -> str:
    """A text that a terminal shows as it is: control and direction signs, and what the encoding lacks, are written as escapes."""

    def shown(ch: str) -> bool:
        try:
            return ord(ch) not in _UNSAFE and bool(ch.encode(encoding))
        except (LookupError, UnicodeEncodeError):
            return False

    return "".join(ch if shown(ch) else f"\\u{ord(ch):04x}" if ord(ch) < 0x10000 else f"\\U{ord(ch):08x}" for ch in str(text))


def report_lines(status: str, fingerprint: str, issues: Iterable[tuple[str, str, str]], strict: bool = False) -> tuple[list[str], int]:
    """(lines, exit code) of issues (severity, code, place): 1 for errors, and for warnings where it is strict."""
    issues = list(issues)
    count = lambda s: sum(severity == s for severity, _, _ in issues)
    lines = [f"status: {status}", f"inputs: {fingerprint}", f"errors: {count('error')}, warnings: {count('warning')}"]
    lines += [f"{severity.upper():8}{code} {place}" for severity, code, place in issues]
    return list(map(terminal_safe, lines)), int(bool(count("error") or strict and count("warning")))


def _code(text: object) -> str:
    return "`" + html.escape(label_of(str(text or "")), quote=True).replace("`", "&#96;") + "`"


def cited_record(record: Mapping[str, object]) -> str:
    """One line that cites a record. Of a record that isn't public only its provenance shows: neither its content nor when or by whom it was written."""
    if record.get("visibility") != "public":
        return f"> Content withheld. Provenance: {_code(record.get('id'))}, record {_code(record.get('record_ref'))}, file {_code(record.get('source_file_sha256'))} as declared."
    name = escape_markdown(str(record.get("id") or ""))
    where = f"[{name}]({quote(str(record['url']), safe='%/:=&?~#+!$,;@*[]')})" if record.get("url") else name
    kinds = ", ".join(f"`{escape_markdown(str(k))}`" for k in record.get("evidence_types") or ()) or "none"
    flags = [f"promotion: {record['promotional']}"] if record.get("promotional") not in (None, "no") else []
    flags += ["author: unknown"] if record.get("author_key") == "unknown" else []
    flags += [f"status: {record['source_status']}"] if record.get("source_status") not in (None, "available") else []
    return f"> \"{escape_markdown(str(record.get('excerpt') or ''))}\" - {where}, {escape_markdown(str(record.get('published_at') or '')[:10])}; {kinds}{'; ' + escape_markdown(', '.join(flags)) if flags else ''}"


def findings(title: str, sections: Iterable[tuple[str, list[str], list[tuple]]], citations: Mapping[str, list[Mapping[str, object]]]) -> str:
    """A Markdown report: tables (heading, columns, rows) in the order given, then the cited records of each signal, signals and records by id."""
    out = [f"# {escape_markdown(title)}\n"]
    for heading, columns, rows in sections:
        out.append(f"## {escape_markdown(heading)}\n\n{render_table(columns, rows) if rows else 'None.' + chr(10)}")
    for signal in sorted(citations):
        lines = [cited_record(r) for r in sorted(citations[signal], key=lambda r: str(r.get("id")))]
        out.append(f"### {escape_markdown(signal)}\n\n" + "\n\n".join(lines or ["No records."]) + "\n")
    text = "\n".join(out)
    if len(text.encode()) > MOST_BYTES:
        raise ValueError("the report is larger than a report may be")
    return text


def audit_files(summary: Mapping[str, object], columns: list[str], rows: list[tuple], report: str) -> dict[str, str]:
    """name -> text of a report's three files; audit.json has the hashes of the other two. Rows of a summary that failed are left out of the table."""
    files = {"signals.csv": render_csv(columns, [] if summary.get("status") == "fail" else rows), "findings.md": report}
    hashes = {name: "sha256:" + hashlib.sha256(text.encode()).hexdigest() for name, text in files.items()}
    return files | {"audit.json": render_json({**summary, "artifact_hashes": hashes})}


def blind_packets(order: list[str], packets: Mapping[str, Mapping[str, object]], hidden: Iterable[str]) -> dict[str, str]:
    """path -> text of a bundle for blind scorers: an index with the packets' order and hashes, and a file for each packet, without the hidden fields."""
    if sorted(order) != sorted(packets) or len(set(order)) != len(order):
        raise ValueError("the order must name each packet once")
    hidden = set(hidden)
    files = {f"packets/{name}.json": render_json({k: v for k, v in packets[name].items() if k not in hidden}) for name in order}
    hashes = {path: hashlib.sha256(text.encode()).hexdigest() for path, text in files.items()}
    return files | {"bundle.json": render_json({"blind_order": order, "file_hashes": hashes})}
