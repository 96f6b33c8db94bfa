"""Files saved once: a data source writer that validates, commits by renaming, and leaves nothing of a job that fails."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.pdf import LEAST_BYTES, PAYWALL, SAMPLE

PENDING = "_pending"


def validated(content: bytes | None, least: int = LEAST_BYTES) -> str:
    """``operators.pdf.state`` of bytes that are at hand."""
    if content is None:
        return "missing_file"
    if len(content) < least:
        return "too_small"
    if content[:5] != b"%PDF-":
        return "not_pdf"
    text = content[5 : 5 + SAMPLE].decode("latin-1").lower()
    if any(p in text for p in PAYWALL):
        return "paywalled_or_incomplete"
    return "complete" if "abstract" in text or "references" in text else "missing_paper_markers"


#: Characters of a title by which names of one paper are known, and what a name of year, journal and title is.
MARKED = 40
NAMED = r"^(（[^）]*）)(.*?)(?:（[^（]*)?\.pdf$"


def variant_key(name: str) -> str:
    """What names of one paper share: year and journal, and the title's first characters; other names are only themselves."""
    m = re.match(NAMED, name, re.S)
    return m[1] + m[2][:MARKED] if m else name


@dataclass
class Saved(WriterCommitMessage):
    """Of a task: (temporary name or none, folder, final name, names that are the same paper)."""

    files: list[tuple[str, str, str, list[str]]]
    states: dict[str, int]


class FilesSource(DataSource):
    """Writes rows (folder, name, content binary[, other_names array<string>]) as files below the option ``path``, a folder that
    all executors share (any file system that Arrow knows).

    A row whose content isn't a complete paper (option ``least``: its least size) is counted, not saved. Each task writes its
    files below ``_pending`` under names of its own; only the commit of the whole job renames them, and of an aborted job they
    are deleted. A file that is there stays as it is; one under another name (``other_names``, or a name that was cut off
    elsewhere) is renamed or, if the final name exists, removed; for that a row needs no content. So a job that runs twice leaves what one run leaves."""

    @classmethod
    def name(cls) -> str:
        return "paper_files"

    def schema(self) -> str:
        return "folder string, name string, content binary, other_names array<string>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.least, self.job = options["path"], int(options.get("least", LEAST_BYTES)), uuid.uuid4().hex
        fs, root = self._fs()
        fs.create_dir(f"{root}/{PENDING}/{self.job}", recursive=True)  # not by tasks: one that outlives its job would make it again

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> Saved:
        fs, root = self._fs()
        folder = f"{root}/{PENDING}/{self.job}"
        out = Saved([], {})
        for r in iterator:
            content = None if r["content"] is None else bytes(r["content"])
            state = validated(content, self.least)
            out.states[state] = out.states.get(state, 0) + 1
            others = list(r["other_names"] or []) if "other_names" in r.__fields__ else []
            if state == "missing_file":
                out.files.append(("", r["folder"], r["name"], others))
            if state == "complete":
                temp = f"{folder}/{uuid.uuid4().hex}"
                with fs.open_output_stream(temp) as f:
                    f.write(content)
                out.files.append((temp, r["folder"], r["name"], others))
        return out

    def commit(self, messages: list[Saved | None]) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, root = self._fs()
        there: dict[str, set[str]] = {}
        for temp, folder, name, others in sorted((f for m in messages if m for f in m.files), key=lambda f: (f[1:], not f[0])):
            at = f"{root}/{folder}"
            if at not in there:
                fs.create_dir(at, recursive=True)
                there[at] = {i.base_name for i in fs.get_file_info(FileSelector(at)) if i.type == FileType.File}
            names, key = there[at], variant_key(name)
            old = sorted(n for n in names if n != name and (n in others or variant_key(n) == key))
            if name not in names and (old or temp):
                fs.move(f"{at}/{old.pop(0)}" if old else temp, f"{at}/{name}")
                names.add(name)
            for n in old:
                fs.delete_file(f"{at}/{n}")
            names -= {n for n in names if n != name and (n in others or variant_key(n) == key)}
        self._clean(fs, root)

    def abort(self, messages: list[Saved | None]) -> None:
        self._clean(*self._fs())

    def _clean(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/{PENDING}/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{PENDING}/{self.job}")
