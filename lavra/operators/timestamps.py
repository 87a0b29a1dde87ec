"""Dates and times as programs and people wrote them, in one normal form.

Method: the distinct (text, order of figures, zone) triples of all sources form a dictionary. Each entry is
parsed once by an exhaustive grammar, the parsed dictionary is kept as a table to which later runs only
add entries they haven't seen, and the normal form is joined back to the rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raised whenever the grammar changes, so that entries parsed by an older one are parsed again.
GRAMMAR = 1

# Month names in Portuguese, English and Spanish, without accents.
MONTHS = [
    ["janeiro", "january", "enero", "jan", "ene"],
    ["fevereiro", "february", "febrero", "fev", "feb"],
    ["marco", "march", "marzo", "mar"],
    ["abril", "april", "abr", "apr"],
    ["maio", "may", "mayo", "mai"],
    ["junho", "june", "junio", "jun"],
    ["julho", "july", "julio", "jul"],
    ["agosto", "august", "ago", "aug"],
    ["setembro", "september", "septiembre", "set", "sep", "sept"],
    ["outubro", "october", "octubre", "out", "oct"],
    ["novembro", "november", "noviembre", "nov"],
    ["dezembro", "december", "diciembre", "dez", "dec", "dic"],
]
# Minutes east of UTC of zone letters, in their Brazilian, Portuguese or US meaning.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "azot": -60, "azost": 0, "brt": -180, "brst": -120, "amt": -240,
    "amst": -180, "act": -300, "fnt": -120, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
# Zones given by the name of their place.
PLACES = {"brasilia": "America/Sao_Paulo", "sao paulo": "America/Sao_Paulo", "lisboa": "Europe/Lisbon", "manaus": "America/Manaus",
          "cuiaba": "America/Cuiaba", "recife": "America/Recife", "nova york": "America/New_York", "nova iorque": "America/New_York"}

_MONTH = {name: i for i, names in enumerate(MONTHS, 1) for name in names}
_M = "(?:" + "|".join(sorted(_MONTH, key=len, reverse=True)) + ")"
_DAY_NAME = (
    r"(?:(?:segunda|terca|quarta|quinta|sexta)(?:[- ]feira)?|sabado|domingo|seg|ter|qua|qui|sex|sab|dom|"
    r"(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?)\.?,?\s+"
)
_TIME = r"(?P<H>\d{1,2})\s?(?::|h)\s?(?P<I>\d{2})(?:(?::|m|min)(?P<S>\d{2})(?:[.,]\d+)?)?(?:\s?s|\s?min)?(?:\s?(?P<half>[ap])\.?\s?m\.?)?"
_TIME_H = r"(?P<H>\d{1,2})\s?(?:h(?:oras)?|(?P<half>[ap])\.?m\.?)"
_LETTERS = "(?:" + "|".join(sorted(ZONES, key=len, reverse=True)) + ")"
_OFFSET = r"(?:(?:utc|gmt)\s?)?(?P<sign>[+-])(?P<oh>\d{1,2}):?(?P<om>\d{2})?(?:\s?\([a-z ]+\))?"
_ZONE = rf"(?:\s?\(?(?:{_OFFSET}|(?P<letters>{_LETTERS})|(?:horario|hora)\s(?:oficial\s)?de\s(?P<place>[a-z ]+))\)?)?"
_JOIN = r"(?:\s?(?:t|,|-|as|a las|at|\s)\s?)+"
_DATES = [
    r"(?P<y>\d{4})[-/.](?P<m>\d{1,2})[-/.](?P<d>\d{1,2})",
    r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4}|\d{2})",
    rf"(?P<d>\d{{1,2}})(?:o|a|st|nd|rd|th)?(?:\s?-\s?|\s?/\s?|\s)(?:de\s)?(?P<mon>{_M})\.?(?:\s?-\s?|\s?/\s?|\sde\s|\s|,\s)(?P<y>\d{{4}}|\d{{2}})",
    rf"(?P<mon>{_M})\.?\s(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s(?P<y>\d{{4}})",
]
_FULL = [re.compile(rf"(?:{_DAY_NAME})?{d}(?:{_JOIN}(?:{t}){_ZONE})?", re.ASCII) for d in _DATES for t in (_TIME, _TIME_H)]
_CTIME = re.compile(rf"(?:{_DAY_NAME})?(?P<mon>{_M})\s(?P<d>\d{{1,2}})\s{_TIME}{_ZONE}\s(?P<y>\d{{4}})", re.ASCII)
_COMPACT = re.compile(rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)t?(?P<H>\d\d)(?P<I>\d\d)(?P<S>\d\d)?(?:[.,]\d+)?{_ZONE}", re.ASCII)
_MONTHS_ONLY = [
    re.compile(rf"(?P<mon>{_M})\.?(?:\sde\s|\s?[/-]\s?|\s|,\s)(?P<y>\d{{4}})", re.ASCII),
    re.compile(r"(?P<m>\d{1,2})[/.-](?P<y>\d{4})", re.ASCII),
    re.compile(r"(?P<y>\d{4})[/-](?P<m>\d{1,2})", re.ASCII),
]


def fold(text: str) -> str:
    """Lower case, no accents, single spaces, nothing around; ordinal signs become letters."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", text.replace("−", "-").replace("–", "-").replace("‐", "-")).strip()


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def normalize(raw: str | None, month_first: bool, zone: str | None) -> str | None:
    """The normal form of `raw`, or None where it denotes no real date.

    A time becomes an instant in UTC, a day or month stays as written. `zone` holds where the value names
    none; a time with neither is None, since it names no single instant. A local time that occurs twice is
    the first one, a skipped one takes the offset before the change (what `fold=0` means in Python).
    """
    if not raw:
        return None
    text = fold(raw).strip("[]\"'").strip()
    if text.isascii() and text.isdigit():
        if len(text) in (10, 13):
            seconds = int(text) // (1000 if len(text) == 13 else 1)
            return f"{datetime(1970, 1, 1) + timedelta(seconds=seconds):%Y-%m-%dT%H:%M:%S}Z"
        if len(text) == 8:
            return _day({"y": text[:4], "m": text[4:6], "d": text[6:]}, month_first)
    for pattern in (_CTIME, _COMPACT, *_FULL):
        if match := pattern.fullmatch(text):
            return _instant(match.groupdict(), month_first, zone)
    for pattern in _MONTHS_ONLY:
        if match := pattern.fullmatch(text):
            got = match.groupdict()
            month, year = _MONTH[got["mon"]] if got.get("mon") else int(got["m"]), int(got["y"])
            return f"{year:04d}-{month:02d}" if 1 <= month <= 12 and year > 0 else None
    return None


def _parts(got: dict[str, str | None], month_first: bool) -> date | None:
    year = int(got["y"]) + (2000 if len(got["y"]) == 2 else 0)
    if got.get("a"):
        day, month = (int(got["b"]), int(got["a"])) if month_first else (int(got["a"]), int(got["b"]))
    else:
        day, month = int(got["d"]), _MONTH[got["mon"]] if got.get("mon") else int(got["m"])
    try:
        return date(year, month, day)
    except ValueError:
        return None


def _day(got: dict[str, str | None], month_first: bool) -> str | None:
    day = _parts(got, month_first)
    return day.isoformat() if day else None


def _instant(got: dict[str, str | None], month_first: bool, zone: str | None) -> str | None:
    day = _parts(got, month_first)
    if day is None or got.get("H") is None:
        return day.isoformat() if day else None
    hour, minute, second = int(got["H"]), int(got.get("I") or 0), int(got.get("S") or 0)
    if got.get("half"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if got["half"] == "p" else 0)
    if hour > 23 or minute > 59 or second > 59:
        return None
    local = datetime(day.year, day.month, day.day, hour, minute, second)
    if got.get("sign"):
        east = (int(got["oh"]) * 60 + int(got["om"] or 0)) * (-1 if got["sign"] == "-" else 1)
        if abs(east) > 18 * 60:
            return None
    elif got.get("letters"):
        east = ZONES[got["letters"]]
    else:
        name = PLACES.get(got["place"].strip()) if got.get("place") else zone
        found = _zone(name) if name else None
        if found is None:
            return None
        east = local.replace(tzinfo=found).utcoffset().total_seconds() / 60
    try:
        return f"{local - timedelta(minutes=east):%Y-%m-%dT%H:%M:%S}Z".rjust(20, "0")
    except OverflowError:
        return None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, first, zone = (batch.column(i).to_pylist() for i in range(3))
        found = pa.array([normalize(*x) for x in zip(raw, first, zone)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), found], names=["bruto", "mes_antes", "fuso", "normal"])


def update_dictionary(values: DataFrame, path: str) -> DataFrame:
    """Parse the entries of `values` (bruto, mes_antes, fuso) that the dictionary at `path` lacks, add them
    and return the whole dictionary. Entries without a normal form are kept too, so that they aren't tried
    again. A run that breaks off adds nothing, one that is repeated adds nothing twice."""
    spark = values.sparkSession
    new = values.distinct()
    kept = f"{path}/gramatica={GRAMMAR}"
    if _exists(spark, kept):
        known = spark.read.parquet(kept)
        same = [new[c].eqNullSafe(known[c]) for c in ("bruto", "mes_antes", "fuso")]
        new = new.join(known, same, "left_anti")
    new.mapInArrow(_parse, "bruto string, mes_antes boolean, fuso string, normal string").write.mode("append").parquet(kept)
    return spark.read.parquet(kept)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def normalize_values(values: DataFrame, path: str) -> DataFrame:
    """`values` with the columns bruto (string), mes_antes (boolean: month before day) and fuso (string) gets
    the column `normal`; rows whose text denotes no real date are left out, as are null and blank texts.
    The dictionary is kept at `path`. Other columns pass through; a column named `normal` is replaced."""
    rows = values.drop("normal").where(F.trim("bruto") != "").withColumns({"mes_antes": F.coalesce("mes_antes", F.lit(False)), "fuso": F.coalesce("fuso", F.lit(""))})
    found = update_dictionary(rows.select("bruto", "mes_antes", "fuso"), path).where("normal is not null")
    return rows.join(found, ["bruto", "mes_antes", "fuso"])


def message_and_entity_dates(mensagens: DataFrame, entidades: DataFrame, arquivos: DataFrame, path: str) -> DataFrame:
    """One row per value of `mensagens.data` and `entidades.datas[].bruto` that denotes a real date:
    tabela, registro_id, ordem, normal. Rows delivered twice count once; a file delivered twice gives the
    zone of its latest delivery that has one. Rows without an id are left out: nothing could name them."""
    zones = arquivos.where("documento_id is not null and fuso_coleta is not null").groupBy("documento_id").agg(F.max_by("fuso_coleta", F.struct("extraido_em", "fuso_coleta")).alias("fuso_coleta"))
    sent = mensagens.where("mensagem_id is not null and trim(data) <> ''").dropDuplicates(["mensagem_id"]).select(
        F.lit("mensagens").alias("tabela"), F.col("mensagem_id").cast("long").alias("registro_id"), F.lit(0).alias("ordem"), "documento_id",
        F.col("data").alias("bruto"), (F.coalesce("idioma_cliente", F.lit("")) == "en-US").alias("mes_antes"), "fuso_origem",
    )
    held = entidades.where("entidade_id is not null and size(datas) > 0").dropDuplicates(["entidade_id"]).select("entidade_id", "documento_id", F.posexplode("datas").alias("p", "x")).select(
        F.lit("entidades").alias("tabela"), F.col("entidade_id").cast("long").alias("registro_id"), (F.col("p") + 1).alias("ordem"), "documento_id",
        F.col("x.bruto").alias("bruto"), F.lit(False).alias("mes_antes"), F.lit(None).cast("string").alias("fuso_origem"),
    )
    both = sent.unionByName(held).join(zones, "documento_id", "left")
    values = both.select("tabela", "registro_id", "ordem", "bruto", "mes_antes", F.coalesce("fuso_origem", "fuso_coleta").alias("fuso"))
    return normalize_values(values, path).select("tabela", "registro_id", "ordem", "normal")
