"""Identifiers, amounts, addresses and file numbers, found and checked by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions.text import fold

# How identifiers are written.
CPF = r"(?<![\d.])(\d{3}\.\d{3}\.\d{3}-\d{2})(?!\d)"
CNPJ = r"(?<![0-9A-Z.])([0-9A-Z]{2}\.[0-9A-Z]{3}\.[0-9A-Z]{3}/[0-9A-Z]{4}-\d{2})(?!\d)"
CNPJ_BARE = r"(?<!\d)(\d{14})(?!\d)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
MONEY = r"(?i)R\$\s?(\d{1,3}(?:\.\d{3})+|\d+)(?:,(\d{1,2}))?(?:\s*(mil|milh[aã]o|milh[oõ]es|bilh[aã]o|bilh[oõ]es|mi|bi)\b)?"
# Domains of mail that tell nothing of an organisation.
GENERIC_DOMAINS = ["gmail.com", "hotmail.com", "outlook.com", "yahoo.com", "yahoo.com.br", "uol.com.br", "bol.com.br", "terra.com.br", "icloud.com", "live.com", "msn.com", "ig.com.br"]


def _check_digit(code: Column, weights: list[int]) -> Column:
    """The sum of a code's first signs (their code point less 48) by weights, modulo 11."""
    terms = [(F.ascii(F.substring(code, i + 1, 1)) - 48) * w for i, w in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.pmod(total, F.lit(11))


def cpf_ok(c: Column) -> Column:
    """Whether both check digits of a CPF hold, written with or without its signs."""
    d = F.regexp_replace(c, r"\D", "")
    digit = lambda n: F.pmod(_check_digit(d, list(range(n + 1, 1, -1))) * 10, F.lit(11)) % 10
    all_equal = d.rlike(r"^(\d)\1{10}$")
    right = (digit(9) == F.substring(d, 10, 1).try_cast("int")) & (digit(10) == F.substring(d, 11, 1).try_cast("int"))
    return F.coalesce((F.length(d) == 11) & ~all_equal & right, F.lit(False))


def cnpj_ok(c: Column) -> Column:
    """Whether both check digits of a CNPJ hold; its first twelve signs may be letters, worth code point - 48."""
    s = F.regexp_replace(F.upper(c), r"[./-]", "")
    weights = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    digit = lambda w: F.when(_check_digit(s, w) < 2, 0).otherwise(11 - _check_digit(s, w))
    shaped = s.rlike(r"^[0-9A-Z]{12}\d{2}$") & ~s.rlike(r"^(.)\1{13}$")
    right = (digit(weights) == F.substring(s, 13, 1).try_cast("int")) & (digit([6, *weights]) == F.substring(s, 14, 1).try_cast("int"))
    return F.coalesce(shaped & right, F.lit(False))


def cnpj_format(c: Column) -> Column:
    s = F.regexp_replace(F.upper(c), r"[./-]", "")
    p = lambda a, n: F.substring(s, a, n)
    return F.concat(p(1, 2), F.lit("."), p(3, 3), F.lit("."), p(6, 3), F.lit("/"), p(9, 4), F.lit("-"), p(13, 2))


def cpfs(text: Column) -> Column:
    """The valid CPFs of a text, in order; only such with their signs, since bare ones may be phone numbers."""
    return F.filter(F.regexp_extract_all(text, F.lit(CPF), F.lit(1)), cpf_ok)


def cnpjs(text: Column) -> Column:
    """The valid CNPJs of a text in one form: first those with signs, then bare runs of 14 digits."""
    written = F.filter(F.regexp_extract_all(text, F.lit(CNPJ), F.lit(1)), cnpj_ok)
    bare = F.transform(F.filter(F.regexp_extract_all(text, F.lit(CNPJ_BARE), F.lit(1)), cnpj_ok), cnpj_format)
    return F.concat(written, bare)


def emails(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower)


def amounts(text: Column) -> Column:
    """The amounts in reais of a text: as written, and their value in decimal(20,2)."""
    raw = F.regexp_extract_all(text, F.lit(MONEY), F.lit(0))

    def value(r: Column) -> Column:
        whole = F.regexp_replace(F.regexp_extract(r, MONEY, 1), r"\.", "")
        cents = F.rpad(F.regexp_extract(r, MONEY, 2), 2, F.lit("0"))
        unit = fold(F.regexp_extract(r, MONEY, 3))
        times = F.when(unit.startswith("bi"), 1_000_000_000).when(unit == "mil", 1000).when(unit.startswith("mi"), 1_000_000).otherwise(1)
        return (F.concat(whole, F.lit("."), cents).try_cast("decimal(20,2)") * times).cast("decimal(20,2)")

    return F.transform(raw, lambda r: F.struct(F.trim(r).alias("bruto"), value(r).alias("valor")))


def domain(address: Column) -> Column:
    """The organisation's domain of an address, or null where the domain is a public provider's."""
    d = F.lower(F.split_part(address, F.lit("@"), F.lit(2)))
    return F.when((d != "") & ~d.isin(*GENERIC_DOMAINS), d)


# When a page of digital text is read by OCR all the same.
OCR_LEAST_CHARS, OCR_COVERAGE, OCR_MOST_CHARS, RENDER_SIDE = 200, 0.5, 1500, 7000


def ocr_reason(chars: Column, coverage: Column, forced: Column) -> Column:
    """Why a page needs OCR, or null where its digital text will do."""
    return (
        F.when(F.coalesce(forced, F.lit(False)), "forçado")
        .when(F.coalesce(chars, F.lit(0)) < OCR_LEAST_CHARS, "pouco texto digital")
        .when((coverage >= OCR_COVERAGE) & (chars < OCR_MOST_CHARS), "imagem cobre a página")
    )


def image_coverage(boxes: Column, width: Column, height: Column) -> Column:
    """The part of a page that images cover: their boxes (x0, y0, x1, y1) cut to the page, at most 1."""
    def area(b: Column) -> Column:
        w = F.greatest(F.least(b["x1"], width) - F.greatest(b["x0"], F.lit(0.0)), F.lit(0.0))
        h = F.greatest(F.least(b["y1"], height) - F.greatest(b["y0"], F.lit(0.0)), F.lit(0.0))
        return w * h

    total = F.aggregate(F.coalesce(boxes, F.array()), F.lit(0.0), lambda acc, b: acc + area(b))
    return F.when((width > 0) & (height > 0), F.round(F.least(total / (width * height), F.lit(1.0)), 2)).otherwise(0.0)


def effective_dpi(width: Column, height: Column, dpi: Column) -> Column:
    """The resolution at which the longer side (in points) of a page stays within 7,000 pixels."""
    longest = F.greatest(width, height) * dpi / 72
    return F.floor(F.when(longest > RENDER_SIDE, dpi * RENDER_SIDE / longest).otherwise(dpi)).cast("int")


# How file names and headers give the number of a document in the process system.
PROCESS_NUMBER = r"\d{5}\.?\d{6}[/_.\-]?\d{4}[/_.\-]?\d{2}|\d{7}-?\d{2}\.?\d{4}\.?\d\.?\d{2}\.?\d{4}"
FILE_NUMBER = r"(?<!\d)(\d{6,7})(?!\d)"
TREE_NAME = r"^\[(\d+)\]\s*-\s*(\d{6,7})[_\s-]+(.+)$"
HEADER_NUMBER = r"SEI/\w+\s*-\s*(\d{6,7})\s*-\s*([^\n]{0,80})"
DOC_N = r"(?i)^\s*doc(?:umento)?\.?\s*n?[º°o.]?\s*(\d{1,4})\b"
ACT = r"(?i)\b(NOTA T[ÉE]CNICA|DESPACHO|PARECER|OF[ÍI]CIO|DECIS[ÃA]O|NOTA INFORMATIVA)(?:\s+\w+)?\s+N[º°o.]+\s*(\d{1,5}/\d{4})"


def file_identity(path: Column, extension: Column, beginning: Column) -> Column:
    """The document's number and where it was found, by precedence: the file's name, its nearest folder, the
    header of its first pages. Numbers of processes don't count. Null where nothing gives one."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"\.[^.]{1,5}$", "")
    free = lambda c: F.regexp_extract(F.regexp_replace(c, PROCESS_NUMBER, " "), FILE_NUMBER, 1)
    empty = lambda c: F.when(c != "", c)
    tree, in_name = empty(F.regexp_extract(stem, TREE_NAME, 2)), empty(free(stem))
    folders = F.reverse(F.slice(parts, 1, F.size(parts) - 1))
    with_id = F.filter(F.transform(folders, lambda p: free(p)), lambda n: n != "")
    from_folder = F.try_element_at(with_id, F.lit(1))
    depth = F.array_position(F.transform(folders, lambda p: free(p) != ""), True)
    inner = F.array_join(F.slice(parts, F.greatest(F.size(parts) - depth + 1, F.lit(1)).cast("int"), F.greatest(depth, F.lit(1)).cast("int")), "/")
    header = empty(F.regexp_extract(F.substring(beginning, 1, 4000), HEADER_NUMBER, 1))
    kind = empty(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(stem, TREE_NAME, 3), "_+", " "), r"\s+\d+(\s+\d{4})?$", "")))
    number = F.coalesce(tree, in_name, from_folder, header)
    own = tree.isNotNull() | in_name.isNotNull()
    return F.when(
        number.isNotNull(),
        F.struct(
            number.alias("numero"),
            F.when(own, "nome do arquivo").when(from_folder.isNotNull(), "pasta de anexo").otherwise("cabeçalho").alias("fonte"),
            F.regexp_extract(stem, TREE_NAME, 1).try_cast("int").alias("ordem_arvore"),
            kind.alias("tipo_no_nome"),
            (kind.isNotNull() & F.lower(extension).isin(".html", ".htm")).alias("tipo_confiavel"),
            F.when(~own & from_folder.isNotNull(), inner).alias("anexo"),
            F.when(~own & from_folder.isNotNull(), F.regexp_extract(name, DOC_N, 1).try_cast("int")).alias("documento_n"),
            header.alias("numero_no_cabecalho"),
            empty(F.trim(F.regexp_extract(F.substring(beginning, 1, 4000), HEADER_NUMBER, 2))).alias("titulo_no_cabecalho"),
            empty(F.regexp_extract(F.substring(beginning, 1, 4000), ACT, 1)).alias("especie_ato"),
            empty(F.regexp_extract(F.substring(beginning, 1, 4000), ACT, 2)).alias("numero_ato"),
        ),
    )
