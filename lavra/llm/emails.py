"""The words newly written by the sender of an e-mail.

Method: each page's lines are first told apart by layout (header fields, separators, attribution lines, quote
marks, closing blocks, notices). All sentences of the earlier messages of a thread, by their instants, and the lines
of each sender's closing blocks are patterns. A later message is scanned, over its line breaks, with an automaton of
these sentences and their runs of words; matched intervals are merged and subtracted, so that quotes are found
without marks, wrapped anew, joined to other words or in part. The automaton of a page holds, of each run of its
words, the sentence of its thread that held the run first, which comes by an equi-join on thread and run: no thread,
however long, is gathered in one place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.operators.timestamps import normalize
from lavra.session import materialize

from .leaks import words

NEW, HEADER, QUOTE, SIGNATURE, NOTICE = "novo", "cabecalho", "citacao", "assinatura", "aviso"
#: Words of a run, and words from which a copied stretch counts by itself.
RUN, LONG = 5, 12
#: The zone of dates without one, and what undated messages have in place of an instant (later than any).
ZONE, UNDATED = "America/Sao_Paulo", "~"

# Header fields by what they hold, closing formulas, and how notes and notices begin.
FIELDS = {
    "de": ["de", "from", "remetente", "von"],
    "para": ["para", "to", "destinatário", "destinatários", "an"],
    "cc": ["cc", "c/c", "com cópia"],
    "cco": ["cco", "bcc"],
    "data": ["enviado em", "enviada em", "enviado", "enviada", "sent", "data", "date", "data de envio"],
    "assunto": ["assunto", "subject", "betreff", "asunto"],
    "anexo": ["anexo", "anexos", "attachments", "attachment"],
    "outro": ["responder a", "responder para", "reply-to", "importância", "importance", "prioridade"],
}
CLOSINGS = [
    "att", "at.te", "atte", "atenciosamente", "cordialmente", "respeitosamente", "abs", "abç", "abraço", "abraços", "um abraço", "grande abraço", "forte abraço",
    "saudações", "cordiais saudações", "grato", "grata", "muito grato", "muito obrigado", "muito obrigada", "obrigado", "obrigada", "agradecido", "sds", "bjs",
    "com os melhores cumprimentos", "melhores cumprimentos", "cumprimentos", "best regards", "kind regards", "regards", "best", "sincerely", "yours sincerely",
    "yours faithfully", "cheers", "thanks", "thank you", "many thanks", "saludos", "un saludo", "cordiales saludos", "atentamente", "cordialement", "bien à vous",
]
DEVICE = r"enviad[oa] (?:do|da|pelo|pela|a partir|via|de meu|através)\b|sent (?:from|via|with) (?:my|a|the|mobile|mail)?\b|(?:obter|obtenha|baixe) o (?:aplicativo|outlook)|get (?:outlook|the app)\b|enviado desde mi\b"
NOTICES = (
    r"aviso legal\b|aviso de confidencialidade\s*:|confidencial(?:idade)?\s*:|disclaimer\b|est[ae] (?:mensagem|e-?mail|correio)[^.]* (?:pode conter|contém|é confidencial|destina-se|são confidenciais|é destinad)|"
    r"this (?:e-?mail|message)[^.]*(?:confidential|intended|privileged|may contain)|o uso, a cópia|as opiniões aqui expressas|the (?:views|opinions) expressed|antes de imprimir|(?:please )?(?:consider|think of) the environment|"
    r"please consider the environment|se você (?:recebeu|não é o destinatário)[^.]*(?:engano|erro|destinatário)|if you (?:have received|are not the intended)|qualquer (?:uso|divulgação|cópia) não autorizad"
)

_FIELD = re.compile(r"^\s*\*?(" + "|".join(sorted((re.escape(x) for v in FIELDS.values() for x in v), key=len, reverse=True)) + r")\*?\s*:\*?\s*(.*?)\s*$", re.I)
_SLOT = {x: k for k, v in FIELDS.items() for x in v}
_MARK = re.compile(r"^\s*[>|]")
_SEPARATOR = re.compile(r"^\s*(?:[-_=*]{2,}\s*(?:mensagem|e-mail|original|forwarded|encaminhad|begin|início|inicio|reply|resposta)[^\n]*[-_=*]{2,}|(?:início da mensagem encaminhada|begin forwarded message|mensagem encaminhada|forwarded message)\s*:?)\s*$", re.I)
_SAID = r"(?:escreveu|wrote|a écrit|escribió|schrieb|writes|disse|enviou)"
_ATTRIBUTION = re.compile(rf"^\s*[-–—]*\s*(?:(?:em|on|le|el|am|no dia)\b.*\d.*\b{_SAID}\s*(?::|[-–—]{{2,}})?|\S.*\b{_SAID}\s+em\s.*\d.*:|\S[^:]*<[^>]*@[^>]*>\s*{_SAID}\s*:)\s*[-–—]*\s*$", re.I)
_OPENS = re.compile(r"^\s*[-–—]*\s*(?:em|on|le|el|am|no dia)\b.*\d", re.I)
_CLOSES = re.compile(rf"(?:\b{_SAID}\s*(?::|[-–—]{{2,}})|{_SAID}\s+em\s.*\d.*:)\s*[-–—]*\s*$", re.I)
_CLOSING = re.compile(r"^\s*(?:" + "|".join(sorted((re.escape(x) for x in CLOSINGS), key=len, reverse=True)) + r")\s*[,.!;:]*\s*$", re.I)
_RULE = re.compile(r"^\s*(?:--|[-_=~]{3,}|(?:\*\s*){3,}|—+|–+)\s*$")
_DEVICE = re.compile(rf"^\s*(?:{DEVICE})", re.I)
_NOTICE = re.compile(rf"^\s*\*?(?:{NOTICES})", re.I)
_AFTERWORD = re.compile(r"^\s*(?:p\.?\s?s\.?\s?[:.–-]|obs\.?\s*:|em tempo\s*:)", re.I)
_ADDRESS = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»')\]]*\s+")
_QUOTED = re.compile(r"^[\s>|]+")
_REPLY = re.compile(r"^\s*(?:(?:re|res|enc|fwd?|fw|encaminhado|resposta|tr|aw|wg)\s*(?:\[\d+\])?\s*:\s*)+", re.I)


def _plausible(slot: str, value: str) -> bool:
    """Whether a field's value can be what such a field holds, and not a sentence that begins alike."""
    if slot in ("de", "para", "cc", "cco"):
        if "@" in value or "<" in value:
            return True
        return bool(value) and value[-1] not in ".!?" and all(w[0].isupper() or w.lower() in ("de", "da", "do", "dos", "das", "e") for w in re.findall(r"[^\W\d_]+", value)) and not re.match(r"\d", value)
    if slot == "data":
        return bool(re.search(r"\d", value)) and value[-1] not in ".!?"
    return True


def header_block(lines: list[str], at: int) -> tuple[int, dict[str, str]]:
    """The end of the header block that begins at line `at`, and its fields; `at` itself if none does.
    A value may stand on the line after its field. A block has a sender and two more kinds of field."""
    got: dict[str, str] = {}
    i, end = at, at
    while i < len(lines):
        match = _FIELD.match(lines[i])
        if not match:
            # a long list of recipients goes on in the next lines
            if got and list(got)[-1] in ("para", "cc") and _ADDRESS.search(lines[i]) and re.fullmatch(r"[^.!?]*<[^>]+>[;,\s]*.*", lines[i].strip()):
                i += 1
                end = i
                continue
            break
        slot, value, step = _SLOT[match[1].lower()], match[2], 1
        if not value:
            if i + 1 < len(lines) and lines[i + 1].strip() and not _FIELD.match(lines[i + 1]):
                value, step = lines[i + 1].strip(), 2
            elif slot != "assunto":
                if slot not in ("cc", "cco", "anexo"):
                    break
        if slot in got or (value and not _plausible(slot, value)):
            break
        got[slot] = value
        i += step
        end = i
    kinds = set(got) & {"para", "data", "assunto"}
    return (end, got) if "de" in got and len(kinds) >= 2 else (at, {})


def _attribution(lines: list[str], at: int) -> int:
    """The end of the attribution that begins at line `at` and takes up to three lines, or `at`."""
    if _ATTRIBUTION.match(lines[at]):
        return at + 1
    if _OPENS.match(lines[at]) and lines[at].rstrip()[-1:] not in ".!?:":
        joined = lines[at].strip()
        for k in (1, 2):
            if at + k >= len(lines) or not lines[at + k].strip():
                break
            joined += " " + lines[at + k].strip()
            if _CLOSES.search(lines[at + k]) and _ATTRIBUTION.match(joined):
                return at + k + 1
    return at


def label_lines(text: str) -> tuple[list[str], list[str], dict[str, str]]:
    """The lines of a page (split at line feeds), the label of each by layout, and the message's header."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    labels = [""] * len(lines)
    i = 0
    while i < len(lines) and not lines[i].strip():
        i += 1
    end, header = header_block(lines, i)
    labels[i:end] = [HEADER] * (end - i)
    i, mode = end, NEW
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if _MARK.match(line):
            labels[i], mode = QUOTE, NEW
            i += 1
            continue
        start = i + 1 if _SEPARATOR.match(line) else _attribution(lines, i)
        block = start
        while block < len(lines) and not lines[block].strip():
            block += 1
        block_end, _ = header_block(lines, block) if block < len(lines) else (block, {})
        if block_end > block and (start > i or block == i):
            start = block_end
        if start > i:
            labels[i:start] = [QUOTE] * (start - i)
            i = start
            while i < len(lines) and not lines[i].strip():
                i += 1
            if i < len(lines) and not _MARK.match(lines[i]):  # an earlier message without quote marks runs to the end
                labels[i:] = [QUOTE] * (len(lines) - i)
                break
            mode = NEW
            continue
        if _DEVICE.match(line) or _NOTICE.match(line):
            labels[i] = NOTICE
        elif _RULE.match(line) or _CLOSING.match(line):
            labels[i], mode = SIGNATURE, SIGNATURE
        elif mode == SIGNATURE and not _AFTERWORD.match(line):
            labels[i] = SIGNATURE
        else:
            labels[i] = mode = NEW
        i += 1
    return lines, [x if line.strip() else "" for x, line in zip(labels, lines)], header


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(re.sub(r"\s+", " ", text).strip().lower()) - (1 << 63)


def _runs(texts: Column) -> Column:
    """A hash of each run of `RUN` words of a text of words, and of the whole text."""
    words_ = F.split(texts, " ")
    places = F.sequence(F.lit(1), F.greatest(F.size(words_) - (RUN - 1), F.lit(1)))
    runs = F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(words_, i, RUN), " ")))
    return F.array_distinct(F.concat(runs, F.array(F.xxhash64(texts))))


def sentences(lines: list[str], labels: list[str], kinds: tuple[str, ...]) -> list[list[str]]:
    """The words of each sentence in the lines of these kinds. Line breaks and quote marks part nothing; blank lines
    and lines of another kind do."""
    out: list[list[str]] = []
    block: list[str] = []
    last = ""
    for line, label in [*zip(lines, labels), ("", "")]:
        if label != last or not label:
            out += [w for x in _SENTENCE.split(" ".join(block)) if (w := words(x))]
            block = []
        if label in kinds:
            block.append(_QUOTED.sub("", line).strip())
        last = label
    return out


_LAYOUT = (
    "pagina_id long, fio long, remetente long, instante string, frases array<struct<frase long, texto string>>, "
    "novas array<string>, finais array<struct<chave long, texto string>>, linhas array<long>"
)


def _layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (pagina_id, caso_id, texto): the keys of thread and sender, the instant, all sentences, the words of the new
    lines (all in one, and each sentence), the closing lines, and the new lines."""
    sentence = pa.list_(pa.struct([("frase", pa.int64()), ("texto", pa.string())]))
    closing = pa.list_(pa.struct([("chave", pa.int64()), ("texto", pa.string())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), sentence, pa.list_(pa.string()), closing, pa.list_(pa.int64()))
    for batch in batches:
        out: list[list] = [[] for _ in kinds]
        for page, case, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            lines, labels, header = label_lines(text)
            subject = _REPLY.sub("", header.get("assunto") or "").strip().lower()
            sender = _ADDRESS.search(header.get("de") or "")
            said = {" ".join(x) for x in sentences(lines, labels, (NEW, QUOTE))}
            fresh = {" ".join(x) for x in sentences(lines, labels, (NEW,))}
            whole = " ".join(w for line, label in zip(lines, labels) if label == NEW for w in words(line))
            row = (
                page, _key(f"{case}\n{subject}") if subject else None, _key(sender[0]) if sender else None, normalize(header.get("data"), False, ZONE),
                [{"frase": _key(x), "texto": x} for x in said], [*({whole} if whole else ()), *fresh],
                [{"chave": _key(x), "texto": x} for x in {" ".join(words(line)) for line, label in zip(lines, labels) if label == SIGNATURE} if x],
                list({_key(" ".join(words(line))) for line, label in zip(lines, labels) if label == NEW}),
            )
            for column, value in zip(out, row):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["pagina_id", "fio", "remetente", "instante", "frases", "novas", "finais", "linhas"])


def matched_lines(lines: list[str], labels: list[str], patterns: list[str], closings: list[str]) -> set[int]:
    """The new lines (from 0) that the patterns cover: sentences of earlier messages, whole or in runs of words, and
    closing lines of the sender. Matched intervals that touch are one; an interval counts from `LONG` words, or from
    two whole sentences."""
    tokens: list[str] = []
    of_line: dict[int, tuple[int, int]] = {}
    for i, (line, label) in enumerate(zip(lines, labels)):
        if label == NEW:
            found = words(line)
            of_line[i] = (len(tokens), len(tokens) + len(found))
            tokens += found
    automaton = ahocorasick.Automaton()
    for pattern in patterns:
        parts = pattern.split(" ")
        for k in range(max(1, len(parts) - RUN + 1)):
            run = " " + " ".join(parts[k : k + RUN]) + " "
            if run not in automaton:
                automaton.add_word(run, (min(RUN, len(parts)), 0))
        automaton.add_word(f" {pattern} ", (len(parts), 1))
    kept = [False] * len(tokens)
    if len(automaton):
        automaton.make_automaton()
        starts, at = {}, 0
        for k, token in enumerate(tokens):
            starts[at] = k
            at += len(token) + 1
        text = " " + " ".join(tokens) + " "
        spans = []
        for stop, (size, whole) in automaton.iter(text):
            end = starts.get(stop, len(tokens))  # the pattern ends with the space before this word
            spans.append((end - size, end, whole))
        merged: list[list] = []
        for begin, end, whole in sorted(spans):
            if not merged or begin > merged[-1][1]:
                merged.append([begin, end, set()])
            merged[-1][1] = max(merged[-1][1], end)
            if whole:
                merged[-1][2].add((begin, end))
        for begin, end, said in merged:
            if end - begin >= LONG or (len(said) >= 2 and end - begin >= RUN):
                kept[begin:end] = [True] * (end - begin)
    last = {*closings}
    gone = {i for i, (a, b) in of_line.items() if b > a and (all(kept[a:b]) or " ".join(tokens[a:b]) in last)}
    filled = [i for i, (a, b) in of_line.items() if b > a]
    for i, (a, b) in of_line.items():  # a rule or the like between two lines that go
        if a == b:
            before, after = max((x for x in filled if x < i), default=None), min((x for x in filled if x > i), default=None)
            if before in gone and after in gone:
                gone.add(i)
    return gone


def _subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (pagina_id, texto, frases, finais): the lines left after the matched intervals."""
    for batch in batches:
        pages, numbers = [], []
        for page, text, earlier, closing in zip(*(batch.column(i).to_pylist() for i in range(4))):
            lines, labels, _ = label_lines(text)
            gone = matched_lines(lines, labels, earlier or [], closing or []) if earlier or closing else ()
            for i, label in enumerate(labels):
                if label == NEW and i not in gone:
                    pages.append(page), numbers.append(i + 1)
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(numbers, pa.int32())], names=["pagina_id", "linha"])


def _pages(paginas: DataFrame, arquivos: DataFrame) -> DataFrame:
    mails = arquivos.where("tipo_comunicacao = 'e-mail' and documento_id is not null").groupBy("documento_id").agg(F.max("caso_id").alias("caso_id"))
    pages = paginas.where("texto <> '' and pagina_id is not null").select(F.col("pagina_id").cast("long").alias("pagina_id"), "documento_id", F.col("n").cast("int").alias("n") if "n" in paginas.columns else F.lit(1).alias("n"), "texto")
    return pages.join(mails, "documento_id").dropDuplicates(["pagina_id"])


def page_patterns(pages: DataFrame) -> DataFrame:
    """What is to be subtracted from each page (pagina_id, documento_id, n, caso_id, texto): frases, the sentences of
    earlier messages of its thread that share a run of words with its new lines, and finais, closing lines of its
    sender. Pages without either are missing."""
    laid = pages.select("pagina_id", "caso_id", "texto").mapInArrow(_layout, _LAYOUT).join(pages.select("pagina_id", "documento_id", "n"), "pagina_id")
    laid = materialize(laid, "camadas")
    # a page without a header goes on with the message that its file begins with
    heads = laid.where("fio is not null").groupBy("documento_id").agg(F.min_by(F.struct("fio", "remetente", "instante"), F.struct(F.coalesce("n", F.lit(0)), "pagina_id")).alias("h"))
    own = laid.join(heads, "documento_id", "left").withColumn("h", F.when(F.col("fio").isNull() & F.col("remetente").isNull(), F.col("h")).otherwise(F.struct("fio", "remetente", "instante")))
    own = own.select("pagina_id", F.col("h.fio").alias("fio"), F.col("h.remetente").alias("remetente"), F.coalesce("h.instante", F.lit(UNDATED)).alias("instante"), "frases", "novas", "finais", "linhas")
    threaded = own.where("fio is not null")
    # each sentence of a thread once, with the message that held it first: a thread of any length stays small
    when = F.struct("instante", "pagina_id", "remetente")
    said = threaded.select("fio", when.alias("quando"), F.explode("frases").alias("f")).groupBy("fio", "f.frase").agg(F.min("quando").alias("primeira"), F.first("f.texto").alias("texto"))
    # of each run of words, and of each whole sentence, the sentence that held it first: one row for each, however many
    # sentences share it, so that the join is linear in the words of the thread
    first = said.select("fio", F.explode(_runs(F.col("texto"))).alias("marca"), F.struct("primeira", "frase").alias("f")).groupBy("fio", "marca").agg(F.min("f").alias("f")).select("fio", "marca", "f.*")
    probes = threaded.select("fio", "pagina_id", "instante", "remetente", F.explode(F.array_distinct(F.flatten(F.transform("novas", _runs)))).alias("marca"))
    earlier = (F.col("primeira.instante") < F.col("instante")) | ((F.col("primeira.instante") == F.col("instante")) & (F.col("primeira.pagina_id") < F.col("pagina_id")) & ~F.col("primeira.remetente").eqNullSafe(F.col("remetente")))
    hits = probes.join(first, ["fio", "marca"]).where(earlier).select("pagina_id", "fio", "frase").distinct()
    of_thread = hits.join(said.select("fio", "frase", "texto"), ["fio", "frase"]).select("pagina_id", "texto", F.lit(1).alias("de"))
    closing = own.where("remetente is not null").select("remetente", "pagina_id", F.explode("finais").alias("f")).groupBy("remetente", "f.chave").agg(F.countDistinct("pagina_id").alias("n"), F.first("f.texto").alias("texto")).where("n >= 2")
    of_sender = own.where("remetente is not null").select("remetente", "pagina_id", F.explode("linhas").alias("chave")).join(closing, ["remetente", "chave"]).select("pagina_id", "texto", F.lit(2).alias("de"))
    both = of_thread.unionByName(of_sender)
    return both.groupBy("pagina_id").agg(F.collect_set(F.when(F.col("de") == 1, F.col("texto"))).alias("frases"), F.collect_set(F.when(F.col("de") == 2, F.col("texto"))).alias("finais"))


def new_lines(paginas: DataFrame, arquivos: DataFrame) -> DataFrame:
    """The non-blank lines newly written by the sender, of the pages of files with tipo_comunicacao='e-mail':
    pagina_id, linha (from 1). Pages with null or empty text have none; pages and files delivered twice count
    once. Of two messages the one of the earlier instant is the earlier one, undated ones come last, equal instants
    go by pagina_id; the same sender's messages of one instant are copies and take nothing from each other. A page
    whose header can't be read belongs to the message that its file begins with; where that has none either, layout
    alone decides. A line stays where but a part of it was copied."""
    pages = _pages(paginas, arquivos)
    return pages.join(page_patterns(pages), "pagina_id", "left").select("pagina_id", "texto", "frases", "finais").mapInArrow(_subtract, "pagina_id long, linha int")
