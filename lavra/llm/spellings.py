"""Spellings of the same person or organisation within a case.

Method: noisy-channel attribution. Every spelling is a possible canonical form with its frequency as prior; the
channel drops and shortens parts, reorders them, uses nicknames and mistypes, each at a cost. A spelling is
attached to the more complete or more frequent form of greatest posterior, or stays by itself where none is
likely enough. Candidates meet by keys that survive one typing error in a name's part, so no case is
gathered in one place, and all spellings that lead to one form are the entity's.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.session import materialize

#: Log likelihood below which a spelling is an entity of its own.
LEAST = -9.5
#: Shares of all names from which a first name or a word of firms counts as known (so at most 1 / share of them).
KNOWN_FIRST, KNOWN_WORD = 1 / 2000, 1 / 300
#: A word of firms is known by its share of cases too, for a brand may be frequent in one case.
KNOWN_CASES = 1 / 50
ROUNDS = 12
#: Letters beyond which a word's keys are its halves, so that their number is bounded.
LONG_WORD = 40

# Titles, words that tell relatives apart, legal forms, and nicknames by first name.
TITLES = {"sr": "m", "sra": "f", "dr": "m", "dra": "f", "eng": "", "prof": "m", "profa": "f", "d": "f", "dom": "m", "dona": "f", "des": "", "min": "", "adv": "", "exmo": "m", "exma": "f", "senhor": "m", "senhora": "f", "engo": "m", "enga": "f"}
SUFFIXES = {"filho": "filho", "neto": "neto", "junior": "junior", "jr": "junior", "sobrinho": "sobrinho", "segundo": "segundo"}
LEGAL = {"ltda", "limitada", "sa", "eireli", "me", "epp", "cia", "companhia", "inc", "slu"}
PARTICLES = {"de", "da", "do", "das", "dos", "e", "em"}
NICKNAMES = {
    "adriana": ["dri", "drica"], "antonio": ["tonho", "toninho", "toni"], "antonia": ["toninha", "tonha"], "anselmo": ["selmo"], "beatriz": ["bia"],
    "benicio": ["bene", "beni"], "carlos": ["caca", "carlinhos", "cadu"], "cecilia": ["cica", "ceci"], "claudia": ["claudinha", "cau"], "claudio": ["claudinho", "cau"],
    "damiao": ["dami"], "debora": ["deb", "debinha"], "eduardo": ["edu", "dudu", "duda"], "elisangela": ["eli", "lili"], "evandro": ["vandro", "vando"],
    "fabio": ["fabinho", "fa"], "fernanda": ["fe", "nanda", "fernandinha"], "francisco": ["chico", "kiko", "chiquinho", "xico"], "gabriela": ["gabi", "bi"], "getulio": ["gege", "tulio"],
    "gustavo": ["gu", "guga", "gustavinho"], "heitor": ["heitorzinho", "tor"], "helena": ["lena", "leninha"], "henrique": ["rique", "henriquinho", "kike"], "iolanda": ["landa", "ioio"],
    "isabel": ["bel", "isa", "belinha"], "jose": ["ze", "zeca", "zezinho"], "julio": ["julinho", "ju"], "leandro": ["le", "leo", "leandrinho"], "luciana": ["lu", "luci", "lulu", "lucianinha"],
    "lucia": ["lu", "lucinha", "luci", "lulu"], "luis": ["lu", "luisinho", "lulu", "lula"], "marcelo": ["celo", "marcelinho"], "marcia": ["marcinha", "ma"], "marcos": ["marquinhos", "kiko"],
    "margarida": ["guida", "magui", "margo"], "mauricio": ["mau", "mauricinho"], "natalia": ["nat", "nati", "natinha"], "odete": ["dete", "detinha"], "otavio": ["tavinho", "tavio"],
    "patricia": ["paty", "pati", "tita", "patty"], "paula": ["paulinha", "pa"], "paulo": ["paulinho", "pa"], "quiteria": ["quita", "teria"], "rafael": ["rafa", "rafinha"],
    "regina": ["re", "regininha", "gina"], "renata": ["re", "renatinha", "natinha"], "roberto": ["beto", "betinho", "ro"], "rogerio": ["roger", "ro", "rogerinho"], "sergio": ["serginho", "ser"],
    "sonia": ["soninha", "so"], "teresa": ["tete", "teca", "te"], "vicente": ["vicentinho", "vi", "cente"], "vitoria": ["vivi", "vi", "vick", "tori"],
    "joao": ["joaozinho", "jota"], "maria": ["mari", "ma", "mariazinha"], "pedro": ["pedrinho", "pepe"], "ana": ["aninha", "nana"], "joaquim": ["quim", "quincas"], "manuel": ["mane", "manu"],
    "sebastiao": ["tiao"], "fernando": ["nando", "fe"], "ricardo": ["rick", "ricardinho"], "daniel": ["dani"], "daniela": ["dani"], "alexandre": ["xande", "ale"], "aparecida": ["cida"],
}
_NICK = {}
for _name, _all in NICKNAMES.items():
    for _n in _all:
        _NICK.setdefault(_n, set()).add(_name)


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@lru_cache(maxsize=200_000)
def sound(word: str) -> str:
    """A word without the differences of spelling that are heard little: doubled letters, y, w, k, ph, z."""
    return re.sub(r"(.)\1+", r"\1", _letters(word))


def _letters(word: str) -> str:
    return word.replace("ph", "f").replace("y", "i").replace("w", "v").replace("k", "c").replace("z", "s").replace("q", "c").replace("th", "t")


@lru_cache(maxsize=500_000)
def edits(a: str, b: str, most: int = 3) -> int:
    """Insertions, deletions, changes and swaps of neighbours that turn `a` into `b`; most + 1 for more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = row if i == 1 else last, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _tokens(name: str) -> list[str]:
    return [t for t in re.split(r"[\s,;]+", name.strip()) if t]


def parse(name: str, firm: bool) -> list[dict]:
    """The readings of a spelling: parts of a person's name, or brand and activity of a firm."""
    if firm:
        text = fold(re.sub(r"(?i)\bS\s*[./]?\s*A\b\.?|E\.\s?I\.\s?R\.\s?E\.\s?L\.\s?I\.?", " sa ", name))
        words = [w for w in re.findall(r"[a-z0-9]+", text) if w not in PARTICLES]
        core = [w for w in words if w not in LEGAL]
        if core and core[0] in ("empresa", "grupo", "firma") and len(core) > 1:
            core = core[1:]
        return [{"tipo": "f", "primeiro": "", "meios": core, "ultimo": "", "sufixo": "", "genero": "", "atividade": core}] if core else []
    raw = _tokens(name)
    if len(raw) == 1 and re.fullmatch(r"[^\W\d_]+(?:[._-][^\W\d_]+)+", raw[0]) and not re.fullmatch(r"(?:[A-Z]\.)+", raw[0]):
        raw = re.split(r"[._-]", raw[0])
    comma = "," in name
    if comma:
        head, tail = name.split(",", 1)
        if _tokens(tail) and fold(tail).strip(" .") not in SUFFIXES:
            raw = _tokens(tail) + _tokens(head)
    gender, words = "", []
    for k, t in enumerate(raw):
        plain = fold(t).strip(".")
        if plain in TITLES and (t.endswith(".") or plain not in ("d", "des", "min")) and k < len(raw) - 1 and not words:
            if plain == "d":
                words.append(t)  # an initial or a title: both readings follow
                continue
            gender = TITLES[plain] or gender
            continue
        words.append(t)
    if not words:
        return []
    suffix = ""
    if len(words) > 1 and fold(words[-1]).strip(".") in SUFFIXES:
        suffix = SUFFIXES[fold(words.pop()).strip(".")]
    if comma and len(words) > 1:
        for k, w in enumerate(words[:-1]):
            if fold(w).strip(".") in SUFFIXES and not suffix:
                suffix = SUFFIXES[fold(words.pop(k)).strip(".")]
                break
    if len(words) > 1 and not comma and words[0].isupper() and len(words[0].strip(".")) > 2 and not all(w.isupper() for w in words):
        words = words[1:] + words[:1]  # SURNAME Name
    titled = gender != "" or len(raw) > len(words) + bool(suffix)

    def reading(parts: list[str], gender: str, titled: bool) -> dict:
        flat: list[str] = []
        capitals = all(p.isupper() for p in parts)
        kept = [p for k, p in enumerate(parts) if not k or fold(p) not in PARTICLES or (p.isupper() and not capitals) or (len(p) == 1 and p.isupper())]
        for p in kept or parts:
            dots = [x for x in p.split(".") if x]
            if len(dots) > 1 and all(len(x) == 1 for x in dots):
                flat += [fold(x) for x in dots]
            elif len(parts) > 1 and p.isupper() and len(p) == 2 and not p.endswith(".") and not all(q.isupper() for q in parts):
                flat += [fold(x) for x in p]  # initials written together
            else:
                flat.append(fold(p).strip(".'\""))
        flat = [x for x in flat if x] or [fold(parts[0])]
        if len(flat) == 1:
            first, last = ("", flat[0]) if titled else (flat[0], "")
            return {"tipo": "p", "primeiro": first, "meios": [], "ultimo": last, "sufixo": suffix, "genero": gender, "atividade": []}
        return {"tipo": "p", "primeiro": flat[0], "meios": flat[1:-1], "ultimo": flat[-1], "sufixo": suffix, "genero": gender, "atividade": []}

    out = [reading(words, gender, titled)]
    if fold(words[0]) in ("d.", "d") and len(words) > 1:
        out.append(reading(words[1:], "f", True))
    return out


def _part(v: str, c: str, known: set[str]) -> tuple[float, int] | None:
    """Cost and edits of writing the part `c` as `v`."""
    if v == c:
        return 0.0, 0
    if len(v) == 1:
        return (-1.5, 0) if c[:1] == v else None
    if len(c) == 1:
        return (-2.5, 0) if v[:1] == c else None
    if v in known and c in known:
        return None
    if sound(v) == sound(c):
        return -1.0, 1
    n = min(edits(v, c, 2), edits(sound(v), sound(c), 2))
    if n == 1:
        return -2.5, 1
    if n == 2 and min(len(v), len(c)) >= 5:
        return -4.5, 2
    return None


def person(v: dict, c: dict, firsts: set[str], hints: set[str]) -> float | None:
    """Log likelihood of writing the person `c` as `v`; None where they can't be one."""
    if not c["primeiro"] or not c["ultimo"] or len(c["ultimo"]) == 1:
        return None
    whole = bool(v["primeiro"] and v["ultimo"])
    if v["sufixo"] != c["sufixo"]:
        if whole or v["sufixo"]:
            return None
    cost = 0.0 if v["sufixo"] == c["sufixo"] else -3.0
    if v["genero"]:
        last = c["primeiro"][-1:]
        if (v["genero"] == "f" and last == "o") or (v["genero"] == "m" and last == "a"):
            cost -= 4.0
    changes = 0
    if v["primeiro"]:
        nick = any(x == c["primeiro"] or (c["primeiro"] not in firsts and edits(x, c["primeiro"], 1) <= 1) for x in _NICK.get(v["primeiro"], ()))
        got = (-2.0, 0) if nick else _part(v["primeiro"], c["primeiro"], firsts)
        if got is None:
            return None
        cost += got[0]
        changes += got[1]
    if v["ultimo"]:
        got = _part(v["ultimo"], c["ultimo"], set())
        if got is None or (len(v["ultimo"]) == 1):
            return None
        cost += got[0]
        changes += got[1]
    if not whole:
        cost -= 3.0
        if changes > 1 or (not v["ultimo"] and changes and len(v["primeiro"]) < 5):
            return None
    if v["meios"] and c["meios"]:
        best = max((g for a in v["meios"] for b in c["meios"] if (g := _part(a, b, set())) is not None), default=None)
        if best is None:
            return None
        cost += best[0] / 2
        changes += best[1]
    elif v["meios"] or c["meios"]:
        cost -= 0.7
    sure = bool(v["meios"]) and v["meios"] == c["meios"] and len(v["meios"][0]) > 3
    if changes > ((3 + sure) if whole and len(v["primeiro"]) > 1 else 1):
        return None
    if hints:
        cost += 3.0 if any(h[0] == c["primeiro"] and h[1] == c["ultimo"] for h in hints) else -1.0
    return cost


def firm(v: dict, c: dict, words: set[str]) -> float | None:
    """Log likelihood of writing the firm `c` as `v`; None where they can't be one."""
    brand_v, brand_c = [w for w in v["meios"] if not _activity(w, words)], [w for w in c["meios"] if not _activity(w, words)]
    act_v, act_c = [w for w in v["meios"] if _activity(w, words)], [w for w in c["meios"] if _activity(w, words)]
    if not brand_v or not brand_c:
        return None if v["meios"] != c["meios"] else 0.0
    cost, changes = 0.0, 0
    if len(brand_v) != len(brand_c):
        return None
    for a, b in zip(sorted(brand_v), sorted(brand_c)):
        got = _part(a, b, set())
        if got is None or len(a) == 1 or len(b) == 1:
            return None
        cost += got[0]
        changes += got[1]
    if act_v and act_c:
        for a in act_v if len(act_v) <= len(act_c) else act_c:
            others = act_c if len(act_v) <= len(act_c) else act_v
            if not any(a == b or (min(len(a), len(b)) >= 2 and (b.startswith(a) or a.startswith(b))) or edits(a, b, 2) <= (1 if len(a) < 8 else 2) for b in others):
                return None
        cost -= 0.3 * (act_v != act_c)
    elif act_v or act_c:
        cost -= 2.0
    return cost if changes <= 2 else None


@lru_cache(maxsize=100_000)
def _starts(word: str, words: frozenset) -> bool:
    return word in words or any(len(word) >= 3 and w.startswith(word) and len(w) > len(word) for w in words)


def _activity(word: str, words: set[str]) -> bool:
    if _starts(word, words):
        return True
    return len(word) >= 7 and any(abs(len(w) - len(word)) <= 1 and len(w) >= 7 and edits(word, w, 1) <= 1 for w in words)


def _deleted(word: str) -> set[str]:
    """What is left of a word's sound, and of that with one sign left out: words one error apart share one."""
    s = _letters(word)
    if len(s) > LONG_WORD:  # one error leaves the first or the last half as it is, whichever length it makes
        return {f"={xxhash.xxh3_64_hexdigest(part)}" for h in ((len(s) - 1) // 2, len(s) // 2) for part in (f"^{s[:h]}", f"{s[-h:]}$")}
    return {sound(word), s, *(s[:i] + s[i + 1 :] for i in range(len(s)))} if len(s) > 3 else {sound(word), s}


def _maybe_brand(name: str, is_firm: bool) -> bool:
    """Whether a name that isn't known as a firm's may be a brand alone."""
    return not is_firm and re.fullmatch(r"\s*(?:(?:Empresa|Grupo)\s+)?[^\W\d_]{5,}\s*", name) is not None


def keys(readings: list[dict], words: frozenset) -> tuple[set[str], set[str]]:
    """Keys under which a spelling looks for canonical forms, and those under which it is found."""
    seek: set[str] = set()
    found: set[str] = set()
    for r in readings:
        if r["tipo"] == "f":
            brand = [w for w in r["meios"] if not _activity(w, words)] or r["meios"]
            both = {f"f{d}" for w in brand for d in _deleted(w)}
            seek |= both
            found |= both
            continue
        first, last = r["primeiro"], r["ultimo"]
        if first and last:
            both = {f"p{first[0]}{d}" for d in _deleted(last)} | {f"q{last[0]}{d}" for d in _deleted(first) if len(first) > 1}
            for full in _NICK.get(first, ()):  # a nickname may begin otherwise
                seek |= {f"p{full[0]}{d}" for d in _deleted(last)}
            seek |= both
            found |= both | {f"l{d}" for d in _deleted(last)} | {f"n{first}"}
            if len(first) > 1:
                found |= {f"o{d}" for d in _deleted(first)}
        elif last:
            seek |= {f"l{d}" for d in _deleted(last)}
        else:
            seek |= {f"n{f}" for f in _NICK.get(first, ())} | {f"o{d}" for d in _deleted(first)}
    return seek, found


def _rank(r: dict, n: int, name: str, firsts: set[str]) -> tuple:
    """Canonical forms come later in this order: fuller ones, with first names known as such, more frequent ones."""
    full = (len(r["primeiro"]) > 1) + (len(r["ultimo"]) > 1) + bool(r["sufixo"]) if r["tipo"] == "p" else 2 * (len(r["meios"]) > 1)
    return (full, r["primeiro"] in firsts and r["primeiro"] not in _NICK, any(len(m) > 1 for m in r["meios"]) if r["tipo"] == "p" else 0, n, name)


def _first_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, words, cases = [], [], []
        for name, is_firm, case in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for r in parse(name, is_firm)[:1]:
                for w in r["meios"] if is_firm else [r["primeiro"]]:
                    if len(w) > 2:
                        kinds.append(int(is_firm)), words.append(w), cases.append(case)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(words, pa.string()), pa.array(cases, pa.string())], names=["tipo", "palavra", "caso_id"])


def _emit(words: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for case, name, n, is_firm, hints in zip(*(batch.column(i).to_pylist() for i in range(5))):
                seek, found = keys(parse(name, is_firm), words)
                if _maybe_brand(name, is_firm):
                    seek |= keys(parse(name, True), words)[0]
                for key in seek | found:
                    short = key if len(key) <= 80 else xxhash.xxh3_64_hexdigest(key)
                    for column, value in zip(out, (case, short, name, n, key in seek, key in found)):
                        column.append(value)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["caso_id", "chave", "nome", "n", "busca", "serve"])

    return run


def _score(firsts: set[str], words: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cases, vs, cs, scores = [], [], [], []
            for case, v, vn, vf, hints, c, cn, cf in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if vf != cf and not (cf and _maybe_brand(v, vf)):
                    continue
                hint = {tuple(h.split(".")[:2]) for h in hints or ()}
                target = parse(c, cf)
                best = None
                for r in parse(v, cf):
                    for t in target[:1]:
                        if _rank(r, vn, v, firsts) >= _rank(t, cn, c, firsts):
                            continue
                        s = firm(r, t, words) if cf else person(r, t, firsts, hint)
                        if s is not None and (best is None or s > best):
                            best = s
                if best is not None and best >= LEAST:
                    cases.append(case), vs.append(v), cs.append(c), scores.append(best + math.log(cn))
            yield pa.RecordBatch.from_arrays([pa.array(cases, pa.string()), pa.array(vs, pa.string()), pa.array(cs, pa.string()), pa.array(scores, pa.float64())], names=["caso_id", "nome", "forma", "peso"])

    return run


def spellings(achados: DataFrame, comunicacoes: DataFrame) -> DataFrame:
    """The distinct spellings of each case: caso_id, nome, n (times seen), firma, dicas (personal addresses'
    local parts seen with it). Null and blank names and null cases are left out; rows delivered twice count once."""
    found = achados.where("caso_id is not null and trim(nome) <> ''").dropDuplicates(["achado_id"]).select("caso_id", "nome", (F.col("tipo") == "empresas").alias("firma"), F.lit(None).cast("string").alias("dica"))
    people = comunicacoes.where("caso_id is not null and size(nomes) > 0").dropDuplicates(["pessoa_id"]).select("caso_id", F.explode("nomes").alias("nome"), F.lit(None).cast("boolean").alias("firma"), F.regexp_extract(F.coalesce("endereco", F.lit("")), r"^([a-z]+\.[a-z]+(?:\.[a-z]+)?)@", 1).alias("dica")).where("trim(nome) <> ''")
    both = found.unionByName(people.withColumn("dica", F.when(F.col("dica") != "", F.col("dica"))))
    grouped = both.groupBy("caso_id", "nome").agg(F.count("*").alias("n"), F.max("firma").alias("firma"), F.collect_set("dica").alias("dicas"))
    legal = r"(?i)\b(?:ltda|limitada|eireli|e\.i\.r\.e\.l\.i|s\.?\s?/?a\.?$|s\. ?a\.|- me$)|^(?:empresa|grupo) "
    return grouped.withColumn("firma", F.coalesce("firma", F.col("nome").rlike(legal)))


def attribute(achados: DataFrame, comunicacoes: DataFrame) -> DataFrame:
    """Every distinct spelling of each case with its entity: caso_id, nome, n, entidade (the canonical spelling)."""
    names = materialize(spellings(achados, comunicacoes), "nomes")
    heard_in = names.select("nome", "firma", "caso_id").mapInArrow(_first_counts, "tipo int, palavra string, caso_id string").groupBy("tipo", "palavra", "caso_id").count()
    counts = materialize(heard_in.groupBy("tipo", "palavra").agg(F.sum("count").alias("count"), F.count("*").alias("casos")), "palavras")
    cases = names.select("caso_id").distinct().count()
    total = {r["tipo"]: r["n"] for r in counts.groupBy("tipo").agg(F.sum("count").alias("n")).collect()}
    kept = counts.where(((F.col("tipo") == 0) & (F.col("count") >= max(3, total.get(0, 0) * KNOWN_FIRST))) | ((F.col("tipo") == 1) & (F.col("count") >= max(3, total.get(1, 0) * KNOWN_WORD)) & (F.col("casos") >= max(2, cases * KNOWN_CASES)))).collect()
    heard = {r["palavra"]: r["count"] for r in kept if r["tipo"] == 0}
    # a frequent mistyping isn't a name: another one, ten times as frequent, lies one error away
    firsts = {w for w, n in heard.items() if not any(m >= 10 * n and edits(w, x, 1) <= 1 for x, m in heard.items() if x != w)}
    words = frozenset(r["palavra"] for r in kept if r["tipo"] == 1)
    # names of firms without a legal form, seen with correspondents only
    pattern = "|".join(sorted(re.escape(w) for w in words if len(w) >= 5)) or "$^"
    plain = F.translate(F.lower("nome"), "áàâãéêíóôõúç", "aaaaeeiooouc")
    names = names.withColumn("firma", F.col("firma") | plain.rlike(rf"\b(?:{pattern})\b"))
    emitted = materialize(names.select("caso_id", "nome", "n", "firma", "dicas").mapInArrow(_emit(words), "caso_id string, chave string, nome string, n long, busca boolean, serve boolean"), "chaves")
    v = emitted.where("busca").select("caso_id", "chave", F.col("nome").alias("v"))
    c = emitted.where("serve").select("caso_id", "chave", F.col("nome").alias("c"))
    pairs = v.join(c, ["caso_id", "chave"]).where("v <> c").select("caso_id", "v", "c").distinct()
    left = names.select("caso_id", F.col("nome").alias("v"), F.col("n").alias("vn"), F.col("firma").alias("vf"), "dicas")
    right = names.select("caso_id", F.col("nome").alias("c"), F.col("n").alias("cn"), F.col("firma").alias("cf"))
    full = pairs.join(left, ["caso_id", "v"]).join(right, ["caso_id", "c"]).select("caso_id", "v", "vn", "vf", "dicas", "c", "cn", "cf")
    scored = full.mapInArrow(_score(firsts, words), "caso_id string, nome string, forma string, peso double")
    best = scored.groupBy("caso_id", "nome").agg(F.max_by("forma", F.struct("peso", "forma")).alias("forma"))
    links = materialize(names.select("caso_id", "nome", "n").join(best, ["caso_id", "nome"], "left").withColumn("forma", F.coalesce("forma", "nome")), "elos")
    for _ in range(ROUNDS):  # each round doubles the way that a spelling has gone up
        up = links.select("caso_id", F.col("nome").alias("forma"), F.col("forma").alias("acima"))
        further = materialize(links.join(up, ["caso_id", "forma"]).select("caso_id", "nome", "n", F.col("acima").alias("forma"), (F.col("acima") != F.col("forma")).alias("mudou")), "elos")
        links = further.drop("mudou")
        if further.where("mudou").isEmpty():
            break
    return links.withColumnRenamed("forma", "entidade")


def same_names(achados: DataFrame, comunicacoes: DataFrame) -> DataFrame:
    """Pairs nome_a < nome_b (by code point) of different spellings of one entity in one caso_id."""
    of = attribute(achados, comunicacoes)
    a = of.select("caso_id", "entidade", F.col("nome").alias("nome_a"))
    b = of.select("caso_id", "entidade", F.col("nome").alias("nome_b"))
    return a.join(b, ["caso_id", "entidade"]).where("nome_a < nome_b").select("caso_id", "nome_a", "nome_b")
