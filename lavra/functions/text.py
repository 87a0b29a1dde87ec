"""String functions as column expressions; all stay in the JVM. Null in, null out."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _letters() -> tuple[str, str]:
    """Letters that Unicode decomposes into one other sign and marks, and these signs, place by place."""
    found = {}
    for code in range(0xC0, 0x2200):
        whole = unicodedata.normalize("NFD", chr(code))
        bare = "".join(c for c in whole if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(code):
            found[chr(code)] = bare
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _letters()
# Words that carry no meaning in a question.
STOPWORDS = (
    "a o as os um uma uns umas de do da dos das em no na nos nas por pelo pela pelos pelas para com sem sob sobre entre ate e ou que qual quais "
    "quem quando onde como porque se ja nao mais menos muito muita foi foram ser sao era eram tem teve ha houve isso isto esse essa este esta "
    "aquele aquela seu sua seus suas"
).split()


def fold(c: Column) -> Column:
    """Lower case without accents, of the same length as the input, so that offsets stay valid."""
    return F.lower(F.translate(c, ACCENTED, PLAIN))


def fold_word(word: str) -> str:
    """As `fold`, for a word of a query."""
    return word.translate(str.maketrans(ACCENTED, PLAIN)).lower()


def clean_breaks(c: Column) -> Column:
    """Line feeds only, no NUL, no blanks before line ends, at most one blank line, nothing around."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\x00", "")
    c = F.regexp_replace(F.regexp_replace(c, "[ \t ]+\n", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unhyphenate(c: Column) -> Column:
    """Words cut by a hyphen at a line end in one piece."""
    return F.regexp_replace(c, r"(?U)(\w)-[ \t]*\n(?:[ \t]*\n)?[ \t]*(\w)", "$1$2")


def snippet(c: Column, start: Column, end: Column, around: int = 120) -> Column:
    """The text between two offsets (from 0) with `around` signs on both sides, blanks squeezed, and an
    ellipsis where it was cut."""
    first = F.greatest(start - around, F.lit(0))
    body = F.trim(F.regexp_replace(F.substring(c, first + 1, end + around - first), r"\s+", " "))
    return F.concat(F.when(first > 0, "…").otherwise(""), body, F.when(F.length(c) > end + around, "…").otherwise(""))


def name_key(c: Column) -> Column:
    """The same for spellings of a name that differ in case, accents, signs or the form of S/A."""
    joined = F.regexp_replace(fold(c), r"\bs\s*[./]?\s*a\b\.?", " sa ")
    return F.array_join(F.regexp_extract_all(joined, F.lit("([a-z0-9]+)"), F.lit(1)), " ")


def tokens(c: Column) -> Column:
    """Folded words of a text: runs of letters and digits."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def contains_term(text: Column, term: Column) -> Column:
    """Whether the words of `term` follow each other in `text`, whatever case, accents and signs."""
    words = F.array_join(tokens(term), " ")
    return (words != "") & F.contains(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")), F.concat(F.lit(" "), words, F.lit(" ")))


def safe_name(c: Column) -> Column:
    """A name that any file system takes: signs it may refuse become underscores."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_")), r"[. ]+$", "")


def safe_path(c: Column) -> Column:
    """A relative path confined to its root: no empty, `.` and `..` parts, each part a safe name."""
    parts = F.filter(F.split(F.translate(c, "\\", "/"), "/"), lambda p: ~F.trim(p).isin("", ".", ".."))
    return F.array_join(F.transform(parts, safe_name), "/")


def link(path: Column) -> Column:
    """A relative path as a URL, each part encoded by itself."""
    return F.array_join(F.transform(F.split(F.translate(path, "\\", "/"), "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


def highlight(c: Column, mark: str = "mark") -> Column:
    """HTML of a snippet whose hits stand between « and »."""
    safe = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(safe, F.lit("«"), F.lit(f"<{mark}>")), F.lit("»"), F.lit(f"</{mark}>"))


def locator(number: Column, file_name: Column, doc_n: Column, attachment: Column, pages: Column) -> Column:
    """Where a finding stands: the number of its file or its name, the document or attachment in it, its pages."""
    base = F.when(number.isNotNull(), F.concat(F.lit("SEI nº "), number)).otherwise(file_name)
    inner = F.when(number.isNull(), "").when(doc_n.isNotNull(), F.concat(F.lit(", Doc. "), doc_n.cast("string"))).when(attachment.isNotNull(), F.concat(F.lit(" ("), attachment, F.lit(")"))).otherwise("")
    n = F.coalesce(F.size(pages), F.lit(0))
    listed = F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")
    return F.concat(base, inner, F.when(n <= 0, "").when(n == 1, F.concat(F.lit(", p. "), listed)).otherwise(F.concat(F.lit(", pp. "), listed)))


def locator_document(c: Column) -> Column:
    """A locator without its last page, which names the document."""
    return F.regexp_replace(c, r", p\.(?!.*, p\.).*$", "")


def stable_id(*parts: Column) -> Column:
    """Twelve hexadecimal digits that depend on the parts alone; nulls count as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, 12)


def key_hash(*parts: Column) -> Column:
    """Sixteen hexadecimal digits of the parts' JSON, for telling whether anything they hold has changed."""
    return F.substring(F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))).cast("binary"), 256), 1, 16)


def question_terms(c: Column) -> Column:
    """A question as a query: its words of at least four letters that carry meaning, joined by OU."""
    words = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    kept = F.filter(words, lambda w: (F.length(w) >= 4) & ~fold(w).isin(*STOPWORDS))
    return F.array_join(F.array_distinct(kept), " OU ")


def window_around(text: Column, question: Column, words: int = 250) -> Column:
    """About `words` words of a text around the first one that shares six letters with the question's."""
    all_words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    stems = F.transform(F.filter(F.regexp_extract_all(question, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.length(w) >= 4), lambda w: F.substring(fold(w), 1, 6))
    hit = F.array_position(F.transform(all_words, lambda w: F.array_contains(stems, F.substring(fold(w), 1, 6))), True)
    start = F.greatest(hit - words // 3, F.lit(1)).cast("int")
    return F.array_join(F.slice(all_words, start, words), " ")


def passage_header(place: Column, title: Column, subject: Column) -> Column:
    """What stands before a passage that is turned into a vector; nulls are skipped."""
    return F.concat(F.lit("Documento: "), F.concat_ws(" · ", place, title, subject))
