"""Oversized passages in pieces under a limit, cut at natural boundaries.

Method: a passage is a tree: sections under headings (ranked by marks, tags or numbers), paragraphs between blank
lines, list items by their indentation, sentences, words, characters. Sibling subtrees are merged from the bottom up as
far as the limit allows, and only nodes beyond the limit are opened; a heading stays with what it heads. Each piece but the first begins with the end of the one before, cut at white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm import sentences

LIMIT, OVERLAP = 1200, 120
LEVELS = ["paragrafo", "frase", "palavra", "nenhuma"]
_RUN = re.compile(r"\S+")
#: Headings by markup and by number, and lines that begin an item of a list or are a heading by markup.
_HEADING = re.compile(r"\s*(?:(?P<marks>#{1,6})\s|<h(?P<tag>[1-6])\b)", re.I)
_NUMBERED = re.compile(r"\s*(\d{1,3}(?:\.\d{1,3})*)[.)º]?\s+\S")
_ITEM = re.compile(r"^(?P<indent>[ \t]*)(?:<li\b[^>]*>|(?:[-•*–—▪●◦]|#{1,6}|\(?\d{1,3}(?:\.\d{1,3})*[.)º]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)])[ \t]+\S)", re.M)


def _children(text: str, begin: int, stop: int, level: int, model: sentences.Model) -> list[tuple[int, int]]:
    """The parts of a node one level down, each without white space around it."""
    if level == 1:
        out, at = [], begin
        for end in sentences.boundaries(text, begin, stop, model):
            part = text[at:end]
            size = len(part.strip())
            if size:
                first = at + len(part) - len(part.lstrip())
                out.append((first, first + size))
            at = end
        return out
    return [m.span() for m in _RUN.finditer(text, begin, stop)]


Unit = tuple[int, int, "int | None"]  # begin, end, and the rank of a heading or list item


def _rank(line: str) -> int | None:
    """The rank of a heading: by marks or tags, by the depth of its number, or the lowest for a short line of its own."""
    if match := _HEADING.match(line):
        return len(match["marks"]) if match["marks"] else int(match["tag"])
    if len(line) > 80 or "\n" in line or line[-1] in ".,;:!?…。":
        return None
    number = _NUMBERED.match(line)
    return 10 + number[1].count(".") if number else 20


def _parts(text: str, begin: int, stop: int) -> list[Unit]:
    """The paragraphs of a node, with the ranks of those that are headings."""
    found = [(begin + a, begin + b) for a, b in sentences.paragraphs(text[begin:stop])]
    return [(a, b, _rank(text[a:b])) for a, b in found]


def _items(text: str, begin: int, stop: int) -> list[Unit]:
    """The list items and marked headings of a paragraph with the lines that go on from them, ranked by their
    indentation; what comes before the first is a part too. One part where there are none."""
    starts = [(m.start(), len(m["indent"].expandtabs(4))) for m in _ITEM.finditer(text, begin, stop)]
    out = []
    for (a, rank), (b, _) in zip([(begin, None), *starts], [*starts, (stop, None)]):
        part = text[a:b]
        if part.strip():
            out.append((a + len(part) - len(part.lstrip()), a + len(part.rstrip()), rank))
    return out


def _branches(units: list[Unit]) -> list[list[Unit]]:
    """The subtrees of a node: what each of its highest headings or outermost items heads; single units where none of
    them heads anything."""
    ranks = [r for _, _, r in units[1:] if r is not None]
    if not ranks:
        return [[u] for u in units]
    top, out = min(ranks), [[units[0]]]
    for unit in units[1:]:
        if unit[2] == top:
            out.append([unit])
        else:
            out[-1].append(unit)
    return out


def _leaves(text: str, room: int, model: sentences.Model, lists: bool) -> list[tuple[int, int, int, bool]]:
    """The parts of a text within `room`: begin, end, the level at which the tree was opened for them, and whether the
    part is a heading alone. Siblings are merged from the bottom up; only nodes beyond `room` are opened."""
    leaves: list[tuple[int, int, int, bool]] = []

    def pack(branches: list[list[Unit]], level: int, headed: bool = False) -> None:
        merged: list[list[Unit]] = []
        for branch in branches:
            if merged and branch[-1][1] - merged[-1][0][0] <= room:
                merged[-1] += branch
            else:
                merged.append([*branch])
                if headed and len(merged) > 1 and len(merged[-2]) > 1 and merged[-2][-1][2] is not None and branch[-1][1] - merged[-2][-1][0] <= room:
                    merged[-1].insert(0, merged[-2].pop())  # a heading moves on with what it heads
        for group in merged:
            begin, stop = group[0][0], group[-1][1]
            if stop - begin <= room:
                leaves.append((begin, stop, level, headed and len(group) == 1 and group[0][2] is not None))
            elif len(group) > 1:
                pack(_branches(group), level, headed)
            else:
                open_node(begin, stop, level)

    def open_node(begin: int, stop: int, level: int) -> None:
        if level > 2:
            leaves.extend((a, min(a + room, stop), 4, False) for a in range(begin, stop, room))
            return
        items = _items(text, begin, stop) if lists and level == 1 else []
        if len(items) > 1:
            pack(_branches(items), level)
        else:
            pack([[(a, b, None)] for a, b in _children(text, begin, stop, level, model)] if level else _branches(_parts(text, begin, stop)), level + 1, headed=not level)

    size = len(text.rstrip())
    begin = len(text) - len(text.lstrip())
    if size - begin <= room:
        return [(begin, size, 0, False)]
    open_node(begin, size, 0)
    return leaves


def boundary(text: str, limit: int, model: sentences.Model) -> str:
    """The first kind of boundary that suffices: the deepest level at which the packing opens the tree. Lists aren't
    nodes here, for a line break alone is no kind of its own."""
    return LEVELS[max(1, max(level for _, _, level, _ in _leaves(text, limit, model, lists=False))) - 1]


def cut(text: str, limit: int, overlap: int, model: sentences.Model) -> list[tuple[int, int]]:
    """Begin and end of the pieces, of at most `limit` characters with what they share with the piece before."""
    room = limit - overlap
    if len(text) <= limit:
        return [(0, len(text))]
    out: list[tuple[int, int]] = []
    packed: list[list[int]] = []
    for a, b, _, heading in _leaves(text, room, model, lists=True):  # what was opened may still go with its neighbours
        if packed and b - packed[-1][0] <= room and not heading:
            packed[-1][1] = b
        else:
            packed.append([a, b])
    for k, (a, b) in enumerate(packed):
        first = a
        if k:
            before = packed[k - 1][1]
            first = max(packed[k - 1][0], a - overlap)
            space = re.search(r"\s\S", text[first : before])
            if first > packed[k - 1][0] and not text[first - 1].isspace() and space and first + space.end() - 1 < before and space.end() <= overlap // 3:
                first += space.end() - 1
        out.append((first, b))
    return out


def _passages(passagens: DataFrame) -> DataFrame:
    return passagens.where("passagem_id is not null and texto <> ''").select(F.col("passagem_id").cast("long").alias("passagem_id"), "documento_id", "pagina", "inicio", "texto")


def classify(passagens: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per passage of more than `limit` characters: passagem_id and fronteira, the first kind of
    boundary that suffices. Null texts have no row; a passage delivered twice has one. The sentence model is
    trained on the texts of all passages, long or not."""
    rows = _passages(passagens)
    model = sentences.fit(rows, "texto")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([boundary(t, limit, model) for t in batch.column(1).to_pylist()], pa.string())], names=["passagem_id", "fronteira"])

    long = rows.where(F.length("texto") > limit).select("passagem_id", "texto").dropDuplicates(["passagem_id"])
    return long.mapInArrow(run, "passagem_id long, fronteira string")


def split_passages(passagens: DataFrame, paginas: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The passages of more than `limit` characters in pieces: passagem_id, peca (from 1), inicio, fim, texto.

    inicio and fim count in the page. The passage is looked for in the page's text, at its own inicio first; where
    the page has no such text, its inicio is taken as it is, and where that is null too, the pieces' are null.
    `overlap` must be less than `limit`."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    rows = _passages(passagens)
    model = sentences.fit(rows, "texto")
    long = rows.where(F.length("texto") > limit).dropDuplicates(["passagem_id"])
    pages = paginas.where("texto <> ''").groupBy("documento_id", F.col("n").alias("pagina")).agg(F.min_by("texto", "pagina_id").alias("da_pagina"))
    joined = long.join(pages, ["documento_id", "pagina"], "left").select("passagem_id", "inicio", "texto", "da_pagina")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, at, text, page in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if page is not None and not (at is not None and page.startswith(text, max(at, 0))):
                    found = page.find(text)
                    at = found if found >= 0 else at
                for k, (a, b) in enumerate(cut(text, limit, overlap, model), 1):
                    for column, value in zip(out, (i, k, None if at is None else at + a, None if at is None else at + b, text[a:b])):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["passagem_id", "peca", "inicio", "fim", "texto"])

    return joined.mapInArrow(run, "passagem_id long, peca int, inicio int, fim int, texto string")
