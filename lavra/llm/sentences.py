"""Sentence boundaries across languages and scripts.

Method: a hidden-event n-gram model. Between the tokens around every possible end (an end mark with closing
quotes, a space between Thai words, any two signs of a Chinese or Japanese paragraph without end marks) a boundary
token may stand; the model gives P(boundary | token before) and
P(token after | boundary or not), with classes to back off to. It is trained without labels, by
expectation maximisation over the counts of all texts, where blank lines show boundaries and small letters show
their absence. Neighbouring events are tied by the length of what lies between them; forward-backward
posteriors decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.session import materialize

#: Token types kept are at least this share of all events (so at most 1 / share of them); rarer ones use their class.
SHARE = 1 / 200_000
ROUNDS = 8
#: Types that end paragraphs at this part of the usual rate already count as ends of sentences.
CAUTION = 0.6
#: Types seen less often speak through their class.
LEAST_SEEN = 20
#: Events that the share of all pairs of signs counts as, beside a pair's own.
SIGN_WEIGHT = 20
#: Events that the class of a type counts as, beside the type's own.
WEIGHT = 20
#: A token rare at beginnings speaks no louder than this (log) against a boundary: any name may begin a sentence.
LEAST = -3.0
#: Marks that end sentences by themselves wherever no small letter follows, and the prior of these and of spaces between
#: words of scripts that write sentences apart so.
PLAIN = {"!", "?", "।", "॥", "؟", "۔", "。", "！", "？", "｡", "។", "៕", "။"}
PLAIN_PRIOR = 0.98
PARAGRAPH, INSIDE = "¶", "·"

_CLOSERS = "\"'”’»)\\]」』）〉》“›"
_END = re.compile(
    rf"[.!?…؟।॥۔។៕။]+(?:[{_CLOSERS}]|(?:[   ]»))*(?=\s|$)"  # marks before white space
    rf"|[。！？｡]+[{_CLOSERS}]*"  # marks of scripts without spaces
    r"|(?<=[ก-๏])(?=[  ]+[ก-๏A-ZÀ-Þ])|(?<=[^\W\d_])(?=[  ]+[ก-๎])"  # spaces beside Thai letters
)
_MARKED = re.compile(rf"[.!?…][{_CLOSERS}]*$")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_THAI = re.compile(r"[ก-๏]")
#: Runs of Chinese and Japanese signs; a paragraph of this many without any end mark has events between all of them.
_CJK = re.compile(r"[々-ヿ一-鿿]+")
_CJK_END = re.compile(r"[。！？｡!?]")
UNMARKED = 40
#: Tokens inside sentences: after a letter and a space, or in scripts without spaces after another sign.
_INNER = re.compile(r"(?<=[^\W\d_] )(?![a-zà-öø-ÿก-๏])\S|(?<=[぀-ヿ一-鿿，、」”])[぀-ヿ一-鿿]")
_OPENERS = "\"'«“„‘‚‹「『（([¿¡—–-•*"
_ENUM = re.compile(r"[(\[]?(?:\d+(?:\.\d+)*|[ivxlcIVXLC]+|[a-zA-Z])[.)º°]+$")


def _left(text: str, begin: int, at: int, end: int) -> tuple[str, str]:
    """Type and class of what stands before a possible end whose mark is text[at:end]."""
    mark = text[at:end]
    if not mark:
        return "TH", "TH"
    if mark[0] in "。！？｡":
        return mark, "CJK" + mark[-1]
    k = at
    while k > begin and not text[k - 1].isspace():
        k -= 1
    raw = text[k:at].lstrip(_OPENERS)
    shown = " ".join(mark.split())
    if mark[0] != "." or mark.startswith(".."):
        return shown, shown
    j = k
    while j > begin and text[j - 1].isspace():
        j -= 1
    i = j
    while i > begin and not text[i - 1].isspace():
        i -= 1
    before = text[i:j].lower().strip(_OPENERS + ",;:")
    before = "9" if before[:1].isdigit() else "." if _MARKED.search(before) else before
    if len(raw) == 1 and raw.isalpha():
        return f"{before} X{shown}" if raw.isupper() else f"{before} {raw}{shown}", ("X" if raw.isupper() else "x") + shown
    flat = re.sub(r"\d+(?:[.,/:-]\d+)*", "9", raw.lower())
    if flat == "9":
        return f"{before} 9{shown}", "9" + shown
    if "9" in flat:
        return flat[-12:] + shown, "9x" + shown
    if "." in flat:
        return flat + shown, "x.x" + shown
    size = "w" if len(flat) <= 4 else "word"
    return flat + shown, (size if raw[:1].islower() else "Name" if raw[:1].isupper() else "other") + shown


def _right(text: str, at: int) -> tuple[str, str]:
    """Type and class of the token after white space at `at`."""
    n = len(text)
    while at < n and text[at].isspace():
        at += 1
    if at >= n:
        return PARAGRAPH, PARAGRAPH
    c = text[at]
    if c in _OPENERS or not c.isalnum():
        return c, c
    if c.isdigit():
        return "9", "9"
    if c > "⹿":
        return c, "cjk"
    if _THAI.match(c):
        return "th", "th"
    k = at
    while k < n and (text[k].isalnum() or text[k] in "'’-"):
        k += 1
    word = text[at:k]
    if len(word) == 1 and c.isupper() and text[k : k + 1] == ".":
        return word + ".", "X."
    if c.islower():
        return "lower", "lower"
    if not c.isupper():
        return word, "letter"
    if re.fullmatch(r"[IVXLC]{2,}", word):
        return "ROM", "ROM"
    return word, "X" if len(word) == 1 else "Name" if word[1:].islower() else "CAPS"


def events(text: str, begin: int, stop: int) -> list[tuple[int, int, str, str, str, str]]:
    """The possible ends inside a paragraph text[begin:stop], but for its own end: (place of the mark, place
    after it, type and class before, type and class after)."""
    out = []
    while stop > begin and text[stop - 1].isspace():
        stop -= 1
    if _unmarked(text, begin, stop):
        for match in _CJK.finditer(text, begin, stop):
            out += [(k, k, f"z{text[k - 2 : k]}", "CJKz", text[k], "cjk") for k in range(match.start() + 2, match.end())]
    for match in _END.finditer(text, begin, stop):
        at, end = match.span()
        if end >= stop or at == begin:
            continue
        left, left_class = _left(text, begin, at, end)
        if end - begin <= 24 and _ENUM.fullmatch(text[begin:end].strip()):
            continue  # a number before a heading or an entry of a list
        right, right_class = _right(text, end) if end < stop else (PARAGRAPH, PARAGRAPH)
        out.append((at, end, left, left_class, right, right_class))
    return sorted(out)


def _unmarked(text: str, begin: int, stop: int) -> bool:
    """Whether a paragraph is of Chinese or Japanese signs and holds no end mark."""
    if stop - begin < UNMARKED or not _CJK.search(text, begin, stop):
        return False
    signs = sum(m.end() - m.start() for m in _CJK.finditer(text, begin, stop))
    return signs >= UNMARKED and 2 * signs > stop - begin and not _CJK_END.search(text, begin, stop)


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of the parts between blank lines, without white space around them."""
    at = 0
    for match in [*_BLANK.finditer(text), None]:
        stop = match.start() if match else len(text)
        part = text[at:stop]
        size = len(part.strip())
        if size:
            begin = at + len(part) - len(part.lstrip())
            yield begin, begin + size
        if match:
            at = match.end()


def _forced(right_class: str) -> bool | None:
    """What is known without the model: no sentence begins with a small letter."""
    return False if right_class == "lower" or right_class in ",;:" else None


class Model:
    """Counts by type and class, as expectations of the rounds so far."""

    def __init__(self) -> None:
        self.left: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        self.start: dict[str, float] = defaultdict(float)
        self.inside: dict[str, float] = defaultdict(float)
        self.known_left: set[str] = set()
        self.known_right: set[str] = set()
        self.starts = self.insides = 1.0
        self.rate = [0.2, 0.2]
        self.signs: dict[str, tuple[float, float]] = {}  # pairs of signs before ends and elsewhere; "" for all
        self.cache: dict[tuple[str, str, str, str], float] = {}

    def odds(self, left: str, left_class: str, right: str, right_class: str) -> float:
        """Log odds of a boundary from the n-grams around it."""
        forced = _forced(right_class)
        if forced is not None:
            return 20.0 if forced else -20.0
        if left_class == "CJKz":
            ends, inner = self.signs.get(left, (0.0, 0.0))
            all_ends, all_inner = self.signs.get("", (0.0, 1.0))
            p = (ends + SIGN_WEIGHT * all_ends / (all_ends + all_inner)) / (ends + inner + SIGN_WEIGHT)
            r = right if right in self.known_right else f"#{right_class}"
            s, o = (self.start.get(r, 0.0) + 0.2) / (self.starts + 10), (self.inside.get(r, 0.0) + 0.2) / (self.insides + 10)
            return math.log(max(p, 1e-6) / max(1 - p, 1e-6)) + max(LEAST, math.log(s / o))
        key = (left, left_class, right, right_class)
        found = self.cache.get(key)
        if found is None:
            # Blank lines show a share `rate` of all boundaries, so ends seen there tell how many there are.
            rate = self.rate[left_class.startswith("CJK")]
            ends, inner = self.left.get(f"#{left_class}", (0.0, 0.0))
            prior = min(0.98, (ends / rate + (0.3 if left_class[0] in "Xx" else 2.0)) / (inner + 3.0))  # initials seldom end one
            ends, inner = self.left.get(left, (0.0, 0.0))
            p = PLAIN_PRIOR if left in PLAIN or left_class == "TH" else min(1 - 0.5 / (inner + WEIGHT), (ends / rate + WEIGHT * prior) / (inner + WEIGHT))
            r = right if right in self.known_right else f"#{right_class}"
            s = (self.start.get(r, 0.0) + 0.2) / (self.starts + 10)
            o = (self.inside.get(r, 0.0) + 0.2) / (self.insides + 10)
            if len(self.cache) > 300_000:
                self.cache.clear()
            found = self.cache[key] = math.log(max(p, 1e-6) / max(1 - p, 1e-6)) + max(LEAST, math.log(s / o))
        return found


def train(rows: list[tuple[str, str, str, str, float]]) -> Model:
    """The model from counted events (type and class before, type and class after, count), where the class
    after is PARAGRAPH for ends of paragraphs, and the type before is PARAGRAPH for their beginnings."""
    lefts: Counter[str] = Counter()
    rights: Counter[str] = Counter()
    total = 0.0
    signs: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for left, lc, right, _, n in rows:
        if lc == "CJKz":
            for key in (left, ""):
                signs[key][right != PARAGRAPH] += n
            continue
        lefts[left] += n
        rights[right] += n
        total += n
    model = Model()
    rows = [r for r in rows if r[1] != "CJKz"]
    for turn in range(ROUNDS):
        new, sure = Model(), [[0.0, 0.0], [0.0, 0.0]]
        new.known_left = {k for k, n in lefts.items() if n >= max(LEAST_SEEN, total * SHARE) and k[0] not in "?"}
        new.known_right = {k for k, n in rights.items() if n >= max(LEAST_SEEN, total * SHARE) and k[0] != "?"}
        for left, lc, right, rc, n in rows:
            r = right if right in new.known_right else f"#{rc}"
            if left == PARAGRAPH:  # how sentences begin is seen at the beginnings of paragraphs
                new.start[r] += n
                new.starts += n
                continue
            if rc == "lower":  # decided already; what follows is about the other tokens
                continue
            if left == INSIDE:
                new.inside[r] += n
                new.insides += n
                continue
            if rc == PARAGRAPH:
                q = 1.0
            elif (forced := _forced(rc)) is not None:
                q = float(forced)
            else:  # in the first round the beginnings and ends of paragraphs alone speak
                q = None if turn == 0 else 1 / (1 + math.exp(-max(-30.0, min(30.0, model.odds(left, lc, right, rc)))))
            key = left if left in new.known_left else f"#{lc}"  # a class speaks for its rare types only
            new.left[key][0 if rc == PARAGRAPH else 1] += n
            if left in PLAIN:
                sure[lc.startswith("CJK")][rc != PARAGRAPH] += n
            if rc != PARAGRAPH and q is not None:
                new.start[r] += n * q
                new.starts += n * q
                new.inside[r] += n * (1 - q)
                new.insides += n * (1 - q)
        new.rate = [CAUTION * min(1.0, max(0.005, (a + 1) / (b + 5))) for a, b in sure]
        model = new
    model.left, model.start, model.inside = dict(model.left), dict(model.start), dict(model.inside)
    model.signs = {k: (a, b) for k, (a, b) in signs.items() if a + b >= LEAST_SEEN or not k}
    model.cache = {}
    return model


def _length(words: int) -> float:
    """Log weight of a sentence of so few words between two boundaries."""
    return (-2.5, -1.0, -0.3)[words - 1] if 1 <= words <= 3 else 0.0 if words else -2.5


def boundaries(text: str, begin: int, stop: int, model: Model) -> list[int]:
    """Ends of the sentences inside text[begin:stop], which ends the last one."""
    found = events(text, begin, stop)
    if not found:
        return [stop]
    odds = [model.odds(*e[2:]) for e in found]
    # each factor: log weight where both neighbours are boundaries
    marks = [e[1] for e in found]
    spaceless = [e[3].startswith("CJK") or e[3] == "TH" for e in found]
    edges = [begin, *marks, stop]
    tie = []
    for a, b, k in zip(edges, edges[1:], range(len(edges) - 1)):
        tie.append(0.0 if (k < len(found) and spaceless[k]) or (k and spaceless[k - 1]) else _length(len(text[a:b].split())))
    # forward and backward over the two states of each event, the paragraph's own ends being boundaries
    def add(x: float, y: float) -> float:
        m = max(x, y)
        return m + math.log(math.exp(x - m) + math.exp(y - m))

    forward = []
    yes, no = 0.0, -1e9
    for o, t in zip(odds, tie):
        yes, no = add(yes + t, no) + o, add(yes, no)
        forward.append((yes, no))
    back = [(0.0, 0.0)] * len(odds)
    yes, no = tie[-1], 0.0
    for i in range(len(odds) - 1, -1, -1):
        back[i] = (yes, no)
        yes, no = add(yes + odds[i] + tie[i], no), add(yes + odds[i], no)
    ends = [m for m, (f1, f0), (b1, b0) in zip(marks, forward, back) if f1 + b1 > f0 + b0]
    return [*ends, stop]


def split(text: str, model: Model) -> list[tuple[int, int]]:
    """Begin and end of each sentence, without white space around it."""
    out = []
    for begin, stop in paragraphs(text):
        at = begin
        for end in boundaries(text, begin, stop, model):
            part = text[at:end]
            size = len(part.strip())
            if size:
                first = at + len(part) - len(part.lstrip())
                out.append((first, first + size))
            at = end
    return out


_EVENTS = "antes string, classe_antes string, depois string, classe_depois string, n double"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter[tuple[str, str, str, str]] = Counter()
        inner: Counter[str] = Counter()  # pairs of Chinese or Japanese signs, but for those before an end
        ending: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            for begin, stop in paragraphs(text):
                for _, _, *kinds in events(text, begin, stop):
                    seen[tuple(kinds)] += 1
                last = None
                for last in _END.finditer(text, max(begin, stop - 40), stop):
                    pass
                if last is not None and last.end() == stop and last.start() > begin and not (stop - begin <= 24 and _ENUM.fullmatch(text[begin:stop])):
                    seen[(*_left(text, begin, last.start(), stop), PARAGRAPH, PARAGRAPH)] += 1
                if stop - begin > 60:  # headings begin otherwise than sentences
                    seen[(PARAGRAPH, PARAGRAPH, *_right(text, begin))] += 1
                for match in _CJK.finditer(text, begin, stop):
                    run, last = match[0], match.end()
                    inner.update(map(str.__add__, run[:-2], run[1:-1]))
                    if len(run) > 1:
                        (ending if last < stop and text[last] in "。！？｡" else inner)[run[-2:]] += 1
                part = text[begin:stop]
                for match in _INNER.finditer(part):
                    seen[(INSIDE, INSIDE, *_right(part, match.start()))] += 1
        for pairs, kind in ((inner, INSIDE), (ending, PARAGRAPH)):
            seen.update({(f"z{pair}", "CJKz", kind, kind): n for pair, n in pairs.items()})
        columns = list(zip(*seen)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array([float(n) for n in seen.values()], pa.float64())], names=["antes", "classe_antes", "depois", "classe_depois", "n"])


def fit(texts: DataFrame, column: str) -> Model:
    """Train on all of `texts[column]`. The driver reads the counts of pairs whose share of all events is at
    least SHARE / 4, and those of rarer pairs by their classes: at most 4 / SHARE rows and the pairs of classes."""
    counted = texts.where(F.col(column) != "").select(column).mapInArrow(_count, _EVENTS)
    names = ["antes", "classe_antes", "depois", "classe_depois"]
    counts = materialize(counted.groupBy(*names).agg(F.sum("n").alias("n")), "eventos")
    total = counts.where("classe_antes <> 'CJKz'").agg(F.sum("n")).first()[0] or 0.0
    least = total * SHARE / 4
    own = lambda c, k: F.when(F.col("n") >= least, F.col(c)).when(F.col(c) == PARAGRAPH, F.col(c)).otherwise(F.concat(F.lit("?"), F.col(k)))
    kept = counts.select(own("antes", "classe_antes").alias("antes"), "classe_antes", own("depois", "classe_depois").alias("depois"), "classe_depois", "n").groupBy(*names).agg(F.sum("n").alias("n"))
    return train([(r["antes"], r["classe_antes"], r["depois"], r["classe_depois"], r["n"]) for r in kept.collect()])


def find_sentences(documents: DataFrame) -> DataFrame:
    """One row per sentence of each document's `text`: doc_id, inicio, fim (in code points, the end excluded).
    Null, empty and blank texts have none; `lang` isn't used, since it may be null or wrong. Repeated texts
    count in training as often as they occur."""
    docs = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, begins, ends = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in split(text, model):
                    ids.append(doc), begins.append(a), ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "inicio", "fim"])

    return docs.mapInArrow(run, "doc_id long, inicio int, fim int")
