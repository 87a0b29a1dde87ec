"""Text of scanned pages: damage by line, and continuous paragraphs without it.

Method: lines near a page's edges that recur over a document's pages (by keys that known confusions leave alike, or
nearly alike on neighbouring pages), or have a form that the corpus shows at
edges only, are running headers and footers; number lines that keep step with the pages are page numbers. Words
cut at line ends are joined where the corpus' vocabulary knows the joined word better than the hyphenated
one. Characters are judged against the same vocabulary: a rare word that one known confusion of shapes turns
into a far more frequent one is misread.

Words and line forms are counted over all different texts of pages. What makes up at least a fixed share of all is broadcast, at most
1 / share entries however large the corpus is; the exact counts of the rest come to the pages that ask for them by
joins, so that no decision depends on the share.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.session import materialize

#: Words that are broadcast are at least this share of all words, line forms of all edge lines; others are joined.
WORD_SHARE, FORM_SHARE = 1 / 500_000, 1 / 50_000
#: A reading counts as misread where the right one is this many times as frequent.
RATIO = 20
EDGE = 3
#: Share of equal characters of lines that are nearly alike, and the lengths of lines that are compared so; keys compare
#: lines of any length.
ALIKE, ALIKE_LEAST, ALIKE_MOST = 0.75, 8, 400

HYPHENS = "-‐‑‒–−¬­"
STRAY = "~•¦·^¨|`´°*_<>=\\"
# What a misread character or group may stand for.
CONFUSIONS = {
    "0": ["o"], "1": ["l", "i"], "2": ["z"], "3": ["e"], "4": ["a"], "5": ["s", "õ"], "6": ["b", "ó", "é"], "7": ["t"], "8": ["b"], "9": ["g", "q"],
    "!": ["i", "l"], "|": ["i", "l"], "@": ["a"], "a": ["ã", "á", "â", "à"], "b": ["h"], "c": ["e", "ç"], "e": ["c", "é", "ê"], "f": ["t", "e", "í"],
    "g": ["q"], "h": ["b", "li"], "i": ["í", "l"], "l": ["i"], "m": ["rn"], "n": ["ri"], "o": ["ó", "ô", "õ"], "p": ["r"], "q": ["g"], "t": ["f"],
    "u": ["ú"], "v": ["y"], "y": ["v"], "ã": ["á"], "d": ["cl"], "rn": ["m"], "cl": ["d"], "ri": ["n"], "ii": ["u"], "li": ["h"], "vv": ["w"], "in": ["m"],
}
CLITICS = {"se", "me", "te", "lhe", "lhes", "nos", "vos", "lo", "la", "los", "las", "no", "na", "o", "a", "os", "as"}
#: Of each shape class one sign, for keys that damaged repetitions of a line share.
_SAME = str.maketrans({"0": "o", "1": "i", "!": "i", "|": "i", "l": "i", "@": "a", "c": "e", "f": "e", "t": "e", "q": "g", "9": "g", "y": "v", "b": "h", "p": "r", "5": "s", "8": "h", "6": "h", "2": "z"})

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_CUT = re.compile(rf"[^\W_]*[{re.escape(HYPHENS)}][ \t]*[{re.escape(STRAY)}]?[ \t]*\r?\n\s*[^\s]*")
_NUMBER = re.compile(
    r"^(?P<open>[-–—\[(]+\s*)?(?P<word>p[áa]g(?:ina|s)?\.?|fl[s]?\.?|folhas?|page|p\.)?\s*(?P<value>[0-9OoIl|]{1,5}|[ivxlc]{1,7}|[IVXLC]{1,7})(?:\s*(?P<of>de|of|/)\s*[0-9OoIl]{1,5})?\s*(?P<close>[-–—\])]+)?$", re.I
)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_CELL = re.compile(r"^(?:lote\s+\d+|r\$\s?[\d.,]+(?:\s+(?:mil|milh\w+|bi\w*))?|\d[\d.,]*%?)$", re.I)
_HYPHEN_END = re.compile(rf"([^\W\d_]+(?:-[^\W\d_]+)*)[{re.escape(HYPHENS)}]\s*(?:[{re.escape(STRAY)}]\s*)?$")
_TAIL = re.compile(r"\W*([^\W_]+(?:-[^\W_]+)*)?")
#: The first word of a line with what stands around it.
_FIRST = re.compile(r"\W*[^\W_]*(?:-[^\W_]+)*\S*")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
_OUTER = "\"'()«»“”‘’[]{},;:?…–—"


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def page_number(line: str) -> tuple[str, int, bool] | None:
    """Style, value and whether the style itself says that it is a page's number; None for other lines."""
    text = line.strip(" \t\r" + STRAY)
    match = _NUMBER.match(text)
    if not match:
        return None
    raw = match["value"]
    if re.fullmatch(r"[ivxlc]+", raw.lower()) and not re.search(r"\d", raw):
        value, digits = 0, [_ROMAN[c] for c in raw.lower()]
        for a, b in zip(digits, [*digits[1:], 0]):
            value += a if a >= b else -a
        style = "romano"
    else:
        clean = raw.translate(str.maketrans("OoIl|", "00111"))
        if not clean.isdigit() or not re.search(r"\d", raw):
            return None
        value, style = int(clean), "arabe"
    marked = bool(match["word"] or match["of"] or (match["open"] and match["close"]))
    return f"{style}{(match['word'] or '')[:2].lower()}{(match['open'] or '')[:1]}", value, marked


def _without_number(line: str) -> str:
    """A header or footer without the page's number set off from it by spaces."""
    text = line.strip(" \t\r")
    parts = re.split(r"\s{2,}|\t", text)
    while len(parts) > 1 and page_number(parts[-1]):
        parts.pop()
    while len(parts) > 1 and page_number(parts[0]):
        parts.pop(0)
    return " ".join(parts)


def line_key(line: str) -> int:
    """The same for a running line and its damaged repetitions, as far as the confusions go."""
    out = []
    for token in _fold(_without_number(line)).translate({ord(c): None for c in STRAY.replace("|", "")}).split():
        if re.search(r"[^\W\d_]", token):
            for a, b in (("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("li", "h")):
                token = token.replace(a, b)
            token = token.translate(_SAME)
        out.append(token)
    return xxhash.xxh3_64_intdigest("".join(out)) - (1 << 63)


def line_form(line: str) -> str:
    """The line's kinds of token: names, numbers, short words as they are, longer ones as one kind; in a line of
    capitals all longer words are of another kind."""
    out: list[str] = []
    bare = _without_number(line)
    capitals = bare.isupper()
    for token in bare.split():
        letters = re.sub(r"[\W\d_]", "", token)
        if not letters:
            kind = re.sub(r"\d+", "9", token)
        elif capitals:
            kind = _fold(letters) if len(letters) <= 3 else "C"
        elif letters[0].isupper():
            kind = "N"
        else:
            kind = _fold(letters) if len(letters) <= 3 else "w"
        if not (kind in ("N", "C") and out and out[-1] == kind):
            out.append(kind)
    form = " ".join(out)
    return form if len(form) <= 80 else f"#{xxhash.xxh3_128_hexdigest(form)}"


def _body(text: str) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n")]


def _edges(lines: list[str]) -> tuple[list[int], list[int]]:
    filled = [i for i, x in enumerate(lines) if x.strip()]
    return filled[:EDGE], filled[::-1][:EDGE]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts: how often each word occurs, and each line form at edges and inside pages."""
    for batch in batches:
        words: Counter[str] = Counter()
        edge: Counter[str] = Counter()
        inner: Counter[str] = Counter()
        for text, metodo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.update(_WORD.findall(_CUT.sub(" ", text).lower()))
            if metodo == "ocr":
                lines = _body(text)
                top, low = _edges(lines)
                near = {*top[:2], *low[:2]}
                for i, line in enumerate(lines):
                    if line.strip():
                        (edge if i in near else inner)[line_form(line)] += 1
        rows = [(0, w, n) for w, n in words.items()] + [(1, f, n) for f, n in edge.items()] + [(2, f, n) for f, n in inner.items()]
        kind, key, n = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.string()), pa.array(n, pa.int64())], names=["tipo", "chave", "n"])


class Lexicon:
    """What the corpus counts say: the frequent words, and which line forms belong to edges; `take` adds the rare
    ones of the page at hand."""

    def __init__(self, words: dict[str, int], edge: dict[str, int], inner: dict[str, int]) -> None:
        self.words, self.edge, self.inner = words, edge, inner
        heads: Counter[str] = Counter(w.split("-")[0] for w in words if "-" in w)
        self.heads = {h for h, n in heads.items() if n >= 2}
        self.known: dict[str, bool] = {}
        self.judged: dict[str, bool] = {}
        self.rare: list[str] = []
        self.forms: list[str] = []

    def take(self, forms: list[dict] | None = None, words: list[dict] | None = None) -> None:
        """The counts of rare line forms and words of a page, in place of those of the page before."""
        for f in self.forms:
            del self.edge[f], self.inner[f]
        for w in self.rare:
            del self.words[w]
        self.edge.update((x["chave"], x["a"]) for x in forms or ())
        self.inner.update((x["chave"], x["b"]) for x in forms or ())
        rare = {x["lida"]: x["n"] for x in words or ()}
        self.words.update(rare)
        self.forms, self.rare = [x["chave"] for x in forms or ()], list(rare)

    def is_head(self, word: str) -> bool:
        """Whether at least two words of the corpus begin with `word` and a hyphen; of rare ones this is counted
        under the head with its hyphen."""
        return word in self.heads or self.words.get(f"{word}-", 0) >= 2

    def spoilt(self, token: str) -> bool:
        """Whether a token as it stands in the text is damaged; kept, since tokens recur."""
        found = self.judged.get(token)
        if found is None:
            if len(self.judged) > 300_000:
                self.judged.clear()
            found = self.judged[token] = _damaged_token(token, self)
        return found

    def form_share(self, form: str) -> tuple[int, float]:
        n, m = self.edge.get(form, 0), self.inner.get(form, 0)
        return n, n / (n + m) if n + m else 0.0

    def misread(self, word: str) -> bool:
        """Whether `word` (lower case) is a misreading of a far more frequent word."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            least = max(RATIO * self.words.get(word, 0), RATIO if len(word) > 3 else 2 * RATIO)
            found = self.known[word] = any(self.words.get(v, 0) >= least for v in _readings(word))
        return found

    def own_hyphen(self, head: str, tail: str) -> bool:
        """Whether the hyphen between the two belongs to the word's spelling."""
        a, b = head.lower(), tail.lower()
        first = b.split("-")[0]
        joined = max(self.words.get(a + b, 0), self.words.get(a + first, 0))
        hyphened = max(self.words.get(f"{a}-{b}", 0), self.words.get(f"{a}-{first}", 0))
        if joined or hyphened:
            return hyphened > joined
        if not tail:
            return self.is_head(a) and self.words.get(a, 0) == 0
        if head[-1].islower() and tail[0].isupper():
            return True
        return (self.is_head(a) or first in CLITICS) and (self.words.get(first, 0) > 0 and self.words.get(a, 0) > 0)


def _readings(word: str) -> Iterator[str]:
    """The words that `word` may stand for: all misread signs put right, then one more confusion."""
    odd = [i for i, c in enumerate(word) if not c.isalpha() and c in CONFUSIONS]
    bases = [word]
    for k, i in enumerate(odd):  # of many, all but the first ones take their likeliest reading
        bases = [b[:i] + r + b[i + 1 :] for b in bases for r in CONFUSIONS[b[i]][: None if k < 4 else 1] if len(r) == 1]
    if odd:
        yield from bases
    if len(word) < 3:
        return
    for base in bases:
        for i in range(len(base)):
            for size in (1, 2):
                for r in CONFUSIONS.get(base[i : i + size], ()) if i + size <= len(base) else ():
                    yield base[:i] + r + base[i + size :]


def furniture(lines: list[str], n: int | None, repeated: set[int], lexicon: Lexicon) -> dict[int, str]:
    """Running headers, footers and page numbers, by the place of their line."""
    out: dict[int, str] = {}
    for edge in _edges(lines):
        for k, i in enumerate(edge):
            if i in out:
                continue
            line = lines[i]
            number = page_number(line)
            if number:
                style, value, marked = number
                steady = n is not None and number_key(style, value - n) in repeated
                around = [lines[j].strip() for j in edge[k + 1 : k + 2] if j not in out]
                if marked or steady or (value < 1000 and not any(_CELL.match(x) for x in around)):
                    out[i] = "numero_pagina"
                    continue
                break
            text = line.strip(" \t\r" + STRAY)
            if not text or text[-1] in ".,;:!?" or _CELL.match(text):
                break
            count, share = lexicon.form_share(line_form(line))
            again = line_key(line) in repeated
            small = text[0].islower()  # as most lines of a text begin, too: those need more evidence
            if (again and share >= (0.8 if small else 0.5)) or (count >= (10 if small else 5) and share >= (0.95 if small else 0.8)):
                out[i] = "cabecalho"
                continue
            break
    return out


def number_key(style: str, offset: int) -> int:
    return xxhash.xxh3_64_intdigest(f"\x00{style}\x00{offset}") - (1 << 63)


def _damaged_token(token: str, lexicon: Lexicon) -> bool:
    core = token.strip(_OUTER).rstrip(".!")
    if not core or "/" in core or (("@" in core or "_" in core) and re.search(r"@[\w-]+\.|\w_\w|\.\w{2,4}$", core)) or "www." in core:
        return False
    inner = re.search(rf"[^\W\d_][{re.escape(STRAY)}»«]+[^\W\d_]|^[{re.escape(STRAY)}]+[^\W\d_]|[^\W\d_][{re.escape(STRAY)}]+$", core)
    if inner or ("@" in core and re.search(r"[^\W\d_]", core)):
        return True
    lower = core.lower()
    letters = sum(c.isalpha() for c in core)
    if re.search(r"[\d!]", core):
        if not letters or not re.fullmatch(r"[\w!-]+", core) or re.fullmatch(r"\d+[ºªo°]?[a-z]?", lower) or re.fullmatch(r"v\d+|\d+h\d*|\d+(?:min|km|kg|m|s)", lower):
            return core == "0s" or (bool(letters) and len(core) > 1 and "!" in core)
        if "!" in core or letters >= 3 * (len(core) - letters) or lexicon.misread(lower):
            return True
        return False
    if len(core) < 2 or not re.fullmatch(r"[^\W\d_]+(?:-[^\W\d_]+)*", core):
        return False
    if any(lexicon.words.get(p, 0) >= RATIO and not lexicon.misread(lower) for p in (lower,)):
        return False
    if lexicon.misread(lower):
        return True
    return "-" in lower and any(len(p) > 2 and lexicon.misread(p) for p in lower.split("-"))


def damaged(line: str, lexicon: Lexicon, skip_first: bool, skip_last: bool) -> bool:
    """Whether a body line holds misread, stray or spaced-out characters. The parts of a word that goes on over
    the line's ends are judged elsewhere."""
    tokens = line.split()
    if any(t and not t.strip(STRAY) for t in tokens):
        return not re.fullmatch(r"[_*=\s]{3,}", line.strip())
    for match in _SPACED.finditer(line):
        if lexicon.words.get(match[0].replace(" ", "").lower(), 0) or len(match[0]) >= 9:
            return True
    for k, token in enumerate(tokens):
        if (k == 0 and skip_first) or (k == len(tokens) - 1 and skip_last):
            core = token.strip(HYPHENS + _OUTER)
            if re.search(rf"[{re.escape(STRAY)}!@]|\d", core) and not core.isdigit() and re.search(r"[^\W\d_]", core) and _damaged_token(core, lexicon):
                return True
            continue
        if token == "0" and k + 1 < len(tokens) and tokens[k + 1][0].islower() and tokens[k + 1].strip(".,") not in ("a", "e", "mil"):
            return True
        if lexicon.spoilt(token):
            return True
    return False


def page_cases(text: str, n: int | None, repeated: set[int], after: str | None, lexicon: Lexicon) -> list[tuple[int, str]]:
    """The damage of one page: line (from 1) and kind. `after` is the first body line of the next page."""
    lines = _body(text)
    found = furniture(lines, n, repeated, lexicon)
    out = [(i + 1, tipo) for i, tipo in found.items()]
    body = [i for i, x in enumerate(lines) if x.strip() and i not in found]
    carry, gone = False, ""
    for k, i in enumerate(body):
        line = lines[i]
        follows = lines[body[k + 1]] if k + 1 < len(body) else (after or "")
        cut = _HYPHEN_END.search(line)
        broken = False
        next_gone = ""
        if cut:
            tail = _TAIL.match(follows)[1] or ""
            broken = (bool(tail) or k + 1 == len(body)) and not lexicon.own_hyphen(cut[1], tail)
            if broken:
                out.append((i + 1, "hifen"))
                next_gone = cut[1]
        spoilt = damaged(line, lexicon, carry or (k == 0 and (n or 1) > 1), bool(cut))
        if not spoilt and broken and tail:  # the joined word, if its misread part lies in this line
            whole = (cut[1] + tail).lower()
            spoilt = not lexicon.words.get(whole) and _spoilt_part(cut[1].lower(), tail.lower(), lexicon) == 0
        if not spoilt and gone and carry:
            first = re.match(r"\W*([^\W\d_]+(?:-[^\W\d_]+)*)?", line)[1] or ""
            spoilt = bool(first) and not lexicon.words.get((gone + first).lower()) and _spoilt_part(gone.lower(), first.lower(), lexicon) == 1
        if spoilt:
            out.append((i + 1, "caractere"))
        carry, gone = broken, next_gone
    return out


def _spoilt_part(head: str, tail: str, lexicon: Lexicon) -> int | None:
    """0 or 1 for the part of a cut word that is misread, None where neither is."""
    whole, least = head + tail, RATIO * max(1, lexicon.words.get(head + tail, 0))
    for right in _readings(whole):
        if lexicon.words.get(right, 0) >= least:
            same = next((i for i, (a, b) in enumerate(zip(whole, right)) if a != b), min(len(whole), len(right)))
            return 0 if same < len(head) else 1
    return None


def repair(text: str, n: int | None, repeated: set[int], after: str | None, lexicon: Lexicon, before: str | None = None) -> str:
    """The page as continuous paragraphs: no page furniture, whole words, right characters. `after` completes a word
    cut by the page's end; where `before`, cut by the end of the page before, was completed there, its rest goes."""
    lines = _body(text)
    gone = furniture(lines, n, repeated, lexicon)
    first = next((i for i, x in enumerate(lines) if x.strip() and i not in gone), None)
    if before and first is not None and _TAIL.match(lines[first])[1]:
        lines[first] = lines[first][_FIRST.match(lines[first]).end() :]
        if not lines[first].strip():
            gone[first] = "hifen"
    paragraphs: list[str] = []
    current = ""
    for i, line in enumerate(lines):
        if i in gone:
            continue
        clean = " ".join(_right(t, lexicon) for t in _SPACED.sub(lambda m: _closed(m[0], lexicon), line).split() if t.strip(STRAY))
        if not clean:
            if current and not re.search(rf"[^\W\d_][{re.escape(HYPHENS)}]$", current):
                paragraphs.append(current)
                current = ""
            continue
        cut = _HYPHEN_END.search(current)
        tail = _TAIL.match(clean)[1] or ""
        if cut and tail:
            current = current.rstrip(HYPHENS + " ") + ("-" if lexicon.own_hyphen(cut[1], tail) else "") + clean
        else:
            current = f"{current} {clean}".strip()
    cut = _HYPHEN_END.search(current)
    if cut and after and _TAIL.match(after)[1]:
        tail = _TAIL.match(after)[1]
        rest = " ".join(_right(t, lexicon) for t in after.split())
        current = current.rstrip(HYPHENS + STRAY + " ") + ("-" if lexicon.own_hyphen(cut[1], tail) else "") + rest
    return "\n\n".join([*paragraphs, current] if current else paragraphs)


def _closed(spaced: str, lexicon: Lexicon) -> str:
    """A spaced-out word closed up; single letters around it that are words of their own stay apart."""
    letters = spaced.split(" ")
    for first, last in ((0, 0), (1, 0), (0, 1), (1, 1)):
        word = "".join(letters[first : len(letters) - last])
        if lexicon.words.get(word.lower()):
            return " ".join([*letters[:first], word, *letters[len(letters) - last :]])
    return "".join(letters)


def _right(token: str, lexicon: Lexicon) -> str:
    """A token with its misread characters put right, as far as the vocabulary knows the word."""
    if not lexicon.spoilt(token):
        return token
    bare = "".join(c for c in token if c not in STRAY.replace("|", ""))
    match = re.search(r"[\w!@|]+", bare)
    if not match:
        return bare
    word, best = match[0], ""
    if lexicon.words.get(word.lower(), 0) < RATIO:
        best = max(_readings(word.lower()), key=lambda v: lexicon.words.get(v, 0), default="")
        if not lexicon.words.get(best):
            best = ""
    if best:
        best = best.upper() if word.isupper() and len(word) > 1 else best.capitalize() if word[0].isupper() else best
        bare = bare[: match.start()] + best + bare[match.end() :]
    return bare


def _comparable(line: str) -> str | None:
    """What nearly equal repetitions of a line are found by; None for prose, which may be alike by chance."""
    prose = sum(w[0].islower() and len(w) > 3 for w in line.split()) > 3 or line.rstrip()[-1:] in HYPHENS + ".,;:!?"
    return None if prose else _fold(_without_number(line))


def _edge_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (documento_id, pagina_id, n, texto): each line near an edge, with its key and the text to compare it by."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for doc, page, n, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            lines = _body(text)
            for side, edge in enumerate(_edges(lines)):
                for i in edge:
                    number = page_number(lines[i])
                    if number and n is None:
                        continue
                    key = number_key(number[0], number[1] - n) if number else line_key(lines[i])
                    for column, value in zip(out, (doc, page, n, side, key, None if number else _comparable(lines[i]))):
                        column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["documento_id", "pagina_id", "n", "lado", "chave", "linha"])


def _repeated(edges: DataFrame) -> DataFrame:
    """The keys of each page (pagina_id, chave) that recur in its document: by equal keys on two pages, or by lines
    nearly alike at the same edge of one of the next two pages, whatever their damage."""
    named = edges.where("documento_id <> ''")
    once = named.select("documento_id", "pagina_id", "chave").distinct()
    often = once.groupBy("documento_id", "chave").agg(F.count("*").alias("paginas")).where("paginas >= 2").drop("paginas")
    equal = once.join(often, ["documento_id", "chave"]).select("pagina_id", "chave")
    lines = named.where(F.col("n").isNotNull() & F.length("linha").between(ALIKE_LEAST, ALIKE_MOST))
    ahead = lines.select("documento_id", F.explode(F.array(F.col("n") + 1, F.col("n") + 2)).alias("n"), "lado", F.col("pagina_id").alias("antes"), F.col("chave").alias("chave_antes"), F.col("linha").alias("linha_antes"))
    most = F.floor(F.greatest(F.length("linha"), F.length("linha_antes")) * (1 - ALIKE)).cast("int")
    apart = F.abs(F.length("linha") - F.length("linha_antes"))
    pairs = lines.join(ahead, ["documento_id", "n", "lado"]).where((F.col("chave") != F.col("chave_antes")) & (apart <= most)).where(F.levenshtein("linha", "linha_antes") <= most)
    fuzzy = pairs.select(F.explode(F.array(F.struct("pagina_id", "chave"), F.struct(F.col("antes").alias("pagina_id"), F.col("chave_antes").alias("chave")))).alias("x")).select("x.*")
    return equal.unionByName(fuzzy).distinct()


def _edge_forms(lexicon: Lexicon):
    """Of (pagina_id, texto): the line forms at the edges of each page that aren't broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, forms = [], []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = _body(text)
                for form in {line_form(lines[i]) for edge in _edges(lines) for i in edge}:
                    if form not in lexicon.edge:
                        pages.append(page), forms.append(form)
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(forms, pa.string())], names=["pagina_id", "chave"])

    return run


def _firsts(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ends = [], []
            for n, text, keys, forms in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                lines = _body(text)
                lexicon.take(forms)
                gone = furniture(lines, n, set(keys or ()), lexicon)
                body = [x for i, x in enumerate(lines) if x.strip() and i not in gone]
                out.append(_FIRST.match(body[0])[0] if body else None)
                cut = _HYPHEN_END.search(body[-1]) if body else None
                ends.append(cut[1] if cut else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(ends, pa.string())], names=["documento_id", "pagina_id", "n", "texto", "chaves", "formas", "primeira", "cortada"])

    return run


def _token_words(token: str) -> set[str]:
    """The words that may be looked up for a token and for their readings."""
    out = set()
    for part in (token, token.strip(HYPHENS + _OUTER)):
        core = part.strip(_OUTER).rstrip(".!").lower()
        out |= {core, *core.split("-")}
    match = re.search(r"[\w!@|]+", "".join(c for c in token if c not in STRAY.replace("|", "")))
    return {w for w in (out | {match[0].lower()} if match else out) if re.search(r"[^\W\d_]", w)}


def _joint_words(head: str, tail: str) -> set[str]:
    """The words that `own_hyphen` looks up."""
    a, b = head.lower(), tail.lower()
    first = b.split("-")[0]
    return {a, first, a + b, a + first, f"{a}-{b}", f"{a}-{first}", f"{a}-"}


def asked_words(text: str, n: int | None, repeated: set[int], after: str | None, lexicon: Lexicon, before: str | None = None) -> tuple[set[str], set[str]]:
    """The words whose counts a page needs beside those of the broadcast ones, and those whose readings' too."""
    lines = _body(text)
    found = furniture(lines, n, repeated, lexicon)
    body = [line for i, line in enumerate(lines) if line.strip() and i not in found]
    plain: set[str] = set()
    read: set[str] = set()
    tokens: set[str] = set()
    for k, line in enumerate(body):
        tokens.update(line.split())
        for match in _SPACED.finditer(line):
            letters = match[0].split(" ")
            tokens.update(letters)
            for first, last in ((0, 0), (1, 0), (0, 1), (1, 1)):
                word = "".join(letters[first : len(letters) - last])
                tokens.add(word), read.add(word.lower())
        cut = _HYPHEN_END.search(line)
        if cut:
            follows = body[k + 1] if k + 1 < len(body) else (after or "")
            tail = _TAIL.match(follows)[1] or ""
            first = re.match(r"\W*([^\W\d_]+(?:-[^\W\d_]+)*)?", follows)[1] or ""
            plain |= _joint_words(cut[1], tail)
            read |= {(cut[1] + tail).lower(), (cut[1] + first).lower()}
    if before and body:
        plain |= _joint_words(before, _TAIL.match(body[0])[1] or "")
    if after:
        tokens.update(after.split())
    for token in tokens:
        read |= _token_words(token)
    known = lexicon.words
    return {w for w in plain - read if w not in known}, {w for w in read if w not in known}


def _asks(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, words, readings = [], [], []
            for page, n, text, keys, forms, after, before in zip(*(batch.column(i).to_pylist() for i in range(7))):
                lexicon.take(forms)
                for kind, asked in enumerate(asked_words(text, n, set(keys or ()), after, lexicon, before)):
                    pages += [page] * len(asked)
                    words += asked
                    readings += [bool(kind)] * len(asked)
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(words, pa.string()), pa.array(readings, pa.bool_())], names=["pagina_id", "palavra", "leituras"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (palavra, leituras): each word with itself and, where asked, its readings."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            words, readings, out = [], [], []
            for word, more in zip(batch.column(0)[at : at + 500].to_pylist(), batch.column(1)[at : at + 500].to_pylist()):
                all_ = {word, *_readings(word)} if more else {word}
                words += [word] * len(all_)
                readings += [more] * len(all_)
                out += all_
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(readings, pa.bool_()), pa.array(out, pa.string())], names=["palavra", "leituras", "lida"])


def _answers(asks: DataFrame, rare: DataFrame) -> DataFrame:
    """Of asks (pagina_id, palavra, leituras): pagina_id and raras, the counts of the rare words among them."""
    kept = materialize(asks, "perguntas")
    spread = kept.select("palavra", "leituras").distinct().mapInArrow(_spread, "palavra string, leituras boolean, lida string")
    found = spread.join(rare, "lida").groupBy("palavra", "leituras").agg(F.collect_list(F.struct("lida", "n")).alias("r"))
    return kept.join(found, ["palavra", "leituras"]).groupBy("pagina_id").agg(F.array_distinct(F.flatten(F.collect_list("r"))).alias("raras"))


def count_corpus(paginas: DataFrame) -> tuple[Lexicon, DataFrame | None, DataFrame | None]:
    """The lexicon of all different texts of pages, and the counts of the rest: of words (lida, n) and line forms (chave, a, b), None
    where there is none. Read by the driver are the words of at least `WORD_SHARE` of all words (at most
    1 / WORD_SHARE of them) and the line forms that are at least `FORM_SHARE` of the edge lines."""
    # a text counts once, however many pages are copies of it: copies are no further evidence
    texts = paginas.where("texto <> ''").groupBy("texto").agg(F.max(F.when(F.col("metodo") == "ocr", F.lit("ocr")).otherwise(F.lit(""))).alias("metodo"))
    counts = materialize(texts.mapInArrow(_count, "tipo int, chave string, n long").groupBy("tipo", "chave").agg(F.sum("n").alias("n")), "contagens")
    total = {r["tipo"]: r["n"] for r in counts.groupBy("tipo").agg(F.sum("n").alias("n")).collect()}
    least, least_form = total.get(0, 0) * WORD_SHARE, max(1, total.get(1, 0) * FORM_SHARE)
    words = {r["chave"]: r["n"] for r in counts.where((F.col("tipo") == 0) & (F.col("n") >= least)).collect()}
    forms = counts.where("tipo > 0").groupBy("chave").agg(F.sum(F.when(F.col("tipo") == 1, F.col("n"))).alias("a"), F.coalesce(F.sum(F.when(F.col("tipo") == 2, F.col("n"))), F.lit(0)).alias("b"))
    kept = forms.where(F.col("a") >= least_form).collect()
    lexicon = Lexicon(words, {r["chave"]: r["a"] for r in kept}, {r["chave"]: r["b"] for r in kept})
    heads = counts.where((F.col("tipo") == 0) & F.contains("chave", F.lit("-"))).groupBy(F.concat(F.substring_index("chave", "-", 1), F.lit("-")).alias("lida")).agg(F.count("*").alias("n")).where("n >= 2")
    rare = counts.where((F.col("tipo") == 0) & (F.col("n") < least)).select(F.col("chave").alias("lida"), "n").unionByName(heads)
    return lexicon, rare if least > 1 else None, forms.where(F.col("a") < least_form) if least_form > 1 else None


def _prepared(paginas: DataFrame) -> tuple[DataFrame, Lexicon]:
    """The pages (pagina_id, n, texto, chaves, formas, seguinte, raras) with all that is asked of the corpus."""
    lexicon, rare, rare_forms = count_corpus(paginas)
    pages = paginas.where("metodo = 'ocr' and texto <> '' and pagina_id is not null").select(F.coalesce("documento_id", F.lit("")).alias("documento_id"), F.col("pagina_id").cast("long").alias("pagina_id"), F.col("n").cast("int").alias("n"), "texto").dropDuplicates(["pagina_id"])
    edges = materialize(pages.mapInArrow(_edge_keys, "documento_id string, pagina_id long, n int, lado int, chave long, linha string"), "bordas")
    keys = _repeated(edges).groupBy("pagina_id").agg(F.collect_list("chave").alias("chaves"))
    kind = "array<struct<chave:string,a:bigint,b:bigint>>"
    if rare_forms is None:
        joined = pages.join(keys, "pagina_id", "left").withColumn("formas", F.lit(None).cast(kind))
    else:
        asked = pages.select("pagina_id", "texto").mapInArrow(_edge_forms(lexicon), "pagina_id long, chave string")
        counted = asked.join(rare_forms, "chave").groupBy("pagina_id").agg(F.collect_list(F.struct("chave", "a", "b")).alias("formas"))
        joined = pages.join(keys, "pagina_id", "left").join(counted, "pagina_id", "left")
    joined = joined.select("documento_id", "pagina_id", "n", "texto", "chaves", "formas")
    with_first = materialize(joined.mapInArrow(_firsts(lexicon), f"documento_id string, pagina_id long, n int, texto string, chaves array<long>, formas {kind}, primeira string, cortada string"), "paginas")
    after = with_first.where("n is not null and documento_id <> ''").groupBy("documento_id", (F.col("n") - 1).alias("n")).agg(F.min_by("primeira", "pagina_id").alias("seguinte"))
    before = with_first.where("n is not null and documento_id <> '' and cortada is not null").groupBy("documento_id", (F.col("n") + 1).alias("n")).agg(F.min_by("cortada", "pagina_id").alias("anterior"))
    ready = with_first.join(after, ["documento_id", "n"], "left").join(before, ["documento_id", "n"], "left").select("pagina_id", "n", "texto", "chaves", "formas", "seguinte", "anterior")
    if rare is None:
        return ready.withColumn("raras", F.lit(None).cast("array<struct<lida:string,n:bigint>>")), lexicon
    asks = ready.mapInArrow(_asks(lexicon), "pagina_id long, palavra string, leituras boolean")
    return ready.join(_answers(asks, rare), "pagina_id", "left"), lexicon


def find_damage(paginas: DataFrame) -> DataFrame:
    """One row per line and kind of damage in the pages read by OCR: pagina_id, linha, tipo (hifen, caractere,
    cabecalho, numero_pagina). Null and empty texts have none; a page delivered twice counts once; pages with no
    documento_id or n stand alone. `confianca_media` is not used: it only hints at damage."""
    pages, lexicon = _prepared(paginas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, kinds = [], [], []
            for page, n, text, keys, forms, after, rare in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5, 7))):
                lexicon.take(forms, rare)
                for i, kind in page_cases(text, n, set(keys or ()), after, lexicon):
                    ids.append(page), at.append(i), kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(kinds, pa.string())], names=["pagina_id", "linha", "tipo"])

    return pages.mapInArrow(run, "pagina_id long, linha int, tipo string")


def repair_pages(paginas: DataFrame, join_pages: bool = False) -> DataFrame:
    """The pages read by OCR as continuous paragraphs: pagina_id, texto. A word cut by the page's end stays cut, or,
    with `join_pages`, is completed from the next page of its document, where its rest is left out."""
    pages, lexicon = _prepared(paginas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, text, keys, forms, after, before, rare in zip(*(batch.column(i).to_pylist() for i in range(1, 8))):
                lexicon.take(forms, rare)
                out.append(repair(text, n, set(keys or ()), after if join_pages else None, lexicon, before if join_pages else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["pagina_id", "texto"])

    return pages.mapInArrow(run, "pagina_id long, texto string")
