"""A data source that writes slides as Markdown decks, a file for each deck of a task, all or nothing.

``df.write.format("decks").option("path", folder).save()`` takes rows (deck, ordinal, title, body). Tasks write below a staging
folder of the job; the commit moves the files of the tasks that succeeded into the folder and writes ``_SUCCESS`` with their list;
an abort, and a task that failed or ran twice, leaves nothing. Reading gives the rows back. The folder must be one that the driver
and all executors mount. A deck that several tasks hold has a file from each, so repartition by deck for one file.

Decks, titles and bodies may be any text; a null is written as its absence and read as null.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "deck long, ordinal int, title string, body string"
#: Stands before each slide, with its number and which texts it has.
HEAD = "<!-- slide "


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


def slide_text(ordinal: int | None, title: str | None, body: str | None) -> str:
    """A slide: a head that holds what Markdown can't say exactly, and the slide for readers."""
    # the head holds no end of a comment, and what readers see no line that looks like a head
    texts = [json.dumps(x).replace("-", "\\u002d") for x in (title, body)]
    seen = f"# {title or ''}\n\n{body or ''}\n\n---\n".replace(HEAD, "<!-- Slide ")
    return f'{HEAD}{{"ordinal": {json.dumps(ordinal)}, "title": {texts[0]}, "body": {texts[1]}}} -->\n{seen}'


class DeckWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.staging = os.path.join(folder, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        mine = os.path.join(self.staging, f"{task.partitionId():05d}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}")
        os.makedirs(mine)
        files, n = {}, 0
        try:
            for row in iterator:
                deck = "none" if row.deck is None else str(row.deck)
                if deck not in files:
                    files[deck] = os.path.join(mine, f"{deck}-{task.partitionId():05d}.md")
                with open(files[deck], "a", encoding="utf-8", errors="surrogatepass", newline="") as out:
                    out.write(slide_text(row.ordinal, row.title, row.body))
                n += 1
        except BaseException:
            shutil.rmtree(mine, ignore_errors=True)
            raise
        return Written(sorted(files.values()), n)

    def commit(self, messages: list[Written | None]) -> None:
        before = [x for x in os.listdir(self.folder) if x.endswith(".md")] if self.overwrite else []
        listed = []
        job = uuid.uuid4().hex[:8]
        for path in (f for m in messages if m for f in m.files):
            name = os.path.basename(path).removesuffix(".md") + f"-{job}.md"
            os.replace(path, os.path.join(self.folder, name))
            listed.append(name)
        for name in before:  # what is overwritten goes once the new files stand
            os.remove(os.path.join(self.folder, name))
        with open(os.path.join(self.folder, "_SUCCESS"), "w", encoding="utf-8") as out:
            json.dump({"files": sorted(listed), "rows": sum(m.rows for m in messages if m)}, out)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class DeckReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(os.path.join(self.folder, x)) for x in sorted(os.listdir(self.folder)) if x.endswith(".md")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or partition.value is None:
            return
        deck = os.path.basename(partition.value).rsplit("-", 2)[0]
        with open(partition.value, encoding="utf-8", errors="surrogatepass", newline="") as lines:
            for line in lines:
                if line.startswith(HEAD) and line.endswith(" -->\n"):
                    slide = json.loads(line[len(HEAD) : -5])
                    yield None if deck == "none" else int(deck), slide["ordinal"], slide["title"], slide["body"]


class DeckSource(DataSource):
    """Options: ``path``, the folder."""

    @classmethod
    def name(cls) -> str:
        return "decks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DeckReader:
        return DeckReader(self.options["path"].removeprefix("file:"))

    def writer(self, schema: StructType, overwrite: bool) -> DeckWriter:
        folder = self.options["path"].removeprefix("file:")
        os.makedirs(folder, exist_ok=True)
        return DeckWriter(folder, overwrite)
