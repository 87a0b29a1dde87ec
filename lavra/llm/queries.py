"""Queries on the problems tagged llm, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.session import table

from . import emails, leaks, mixtures, neighbors, pieces, scans, sentences, spellings


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.find_damage(table(spark, sf, "paginas"))


def p1_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return scans.repair_pages(table(spark, sf, "paginas"), join_pages=True)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return spellings.same_names(table(spark, sf, "achados"), table(spark, sf, "comunicacoes"))


def p2_entities(spark: SparkSession, sf: str) -> DataFrame:
    return spellings.attribute(table(spark, sf, "achados"), table(spark, sf, "comunicacoes"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.similar_pairs(table(spark, sf, "passagens"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return emails.new_lines(table(spark, sf, "paginas"), table(spark, sf, "arquivos"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.classify(table(spark, sf, "passagens"))


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_passages(table(spark, sf, "passagens"), table(spark, sf, "paginas"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "itens_teste")).select("doc_id", "item_id")


def p7_near(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.near_copies(table(spark, sf, "documents"), table(spark, sf, "itens_teste")).select("doc_id", "item_id", "palavra", F.round("similaridade", 6).alias("similaridade"))


def p8_selection(spark: SparkSession, sf: str) -> DataFrame:
    return mixtures.select_mixture(table(spark, sf, "documents"), table(spark, sf, "misturas"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixtures.mixture_shares(table(spark, sf, "documents"), table(spark, sf, "misturas"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.find_sentences(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_paragraphs": p1_paragraphs, "p2_found": p2_found, "p2_entities": p2_entities, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_pieces": p6_pieces, "p7_found": p7_found, "p7_near": p7_near, "p8_selection": p8_selection, "p8_shares": p8_shares, "p9_found": p9_found}


def oracle_sql() -> dict[str, str]:
    """The searches that SQL can say, over all rows. The others have no SQL: tests hold them against brute force."""
    unit = "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))"
    return {
        "p4_found": f"""WITH p AS (SELECT DISTINCT ON (passagem_id) passagem_id AS id, modelo, vetor::DOUBLE[] AS v FROM passagens WHERE modelo IS NOT NULL AND len(vetor) > 0),
u AS (SELECT id, modelo, len(v) AS d, {unit} AS e FROM p WHERE len(list_filter(v, lambda x: x IS NULL)) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
s AS (SELECT a.id AS i, b.id AS j, list_dot_product(a.e, b.e) AS c FROM u a JOIN u b ON a.modelo = b.modelo AND a.d = b.d AND a.id <> b.id),
k AS (SELECT i, j FROM s WHERE c >= 0.9 - 1e-9 QUALIFY row_number() OVER (PARTITION BY i ORDER BY c DESC, j) <= 10)
SELECT DISTINCT least(i, j) AS passagem_a, greatest(i, j) AS passagem_b FROM k""",
        "p7_found": r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(strip_accents(nfc_normalize(text))), '[\p{L}\p{N}]+') AS w FROM documents),
v AS (SELECT item_id AS id, regexp_extract_all(lower(strip_accents(nfc_normalize(texto))), '[\p{L}\p{N}]+') AS w FROM itens_teste),
g AS (SELECT id, array_to_string(list_slice(w, k, k + 12), ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS k FROM w WHERE len(w) >= 13)),
h AS (SELECT id, array_to_string(list_slice(w, k, k + 12), ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS k FROM v WHERE len(w) >= 13))
SELECT DISTINCT g.id AS doc_id, h.id AS item_id FROM g JOIN h USING (g)""",
        "p7_near": r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(strip_accents(nfc_normalize(text))), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
v AS (SELECT item_id AS id, regexp_extract_all(lower(strip_accents(nfc_normalize(texto))), '[\p{L}\p{N}]+') AS w FROM itens_teste WHERE item_id IS NOT NULL),
d AS (SELECT id, k - 1 AS p, array_to_string(list_slice(w, k, k + 4), ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 5)),
n AS (SELECT id, len(w) - 4 AS m FROM w WHERE len(w) >= 5),
i AS (SELECT DISTINCT id, array_to_string(list_slice(w, k, k + 4), ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS k FROM v WHERE len(w) >= 5)),
t AS (SELECT count(DISTINCT id)::DOUBLE AS t FROM v WHERE len(w) > 0),
f AS (SELECT s, ln(1 + (SELECT t FROM t) / count(*)) AS x FROM i GROUP BY s),
iw AS (SELECT i.id, i.s, f.x FROM i JOIN f USING (s)),
total AS (SELECT iw.id, sum(x) AS x, min(len(v.w)) - 4 AS m FROM iw JOIN v ON v.id = iw.id GROUP BY iw.id),
c AS (SELECT a.id AS doc_id, b.id AS item_id FROM (SELECT DISTINCT id, s FROM d) a JOIN iw b USING (s) JOIN total ON total.id = b.id GROUP BY a.id, b.id, total.x HAVING sum(b.x) >= 0.8 * total.x - 1e-9),
st AS (SELECT c.doc_id, c.item_id, least(total.m, n.m) AS m, total.x AS whole, unnest(range(0, greatest(n.m - total.m, 0) + 1)) AS p FROM c JOIN n ON n.id = c.doc_id JOIN total ON total.id = c.item_id),
g AS (SELECT DISTINCT st.doc_id, st.item_id, st.p, st.whole, d.s FROM st JOIN d ON d.id = st.doc_id AND d.p >= st.p AND d.p < st.p + st.m),
j AS (SELECT g.doc_id, g.item_id, g.p, coalesce(sum(iw.x), 0) / (g.whole + ln(1 + (SELECT t FROM t)) * sum(CASE WHEN iw.s IS NULL THEN 1 ELSE 0 END)) AS j FROM g LEFT JOIN iw ON iw.id = g.item_id AND iw.s = g.s GROUP BY g.doc_id, g.item_id, g.p, g.whole)
SELECT doc_id, item_id, arg_min(p, (-j, p))::INT AS palavra, round(max(j), 6) AS similaridade FROM (SELECT * REPLACE (round(j, 12) AS j) FROM j WHERE j >= 0.8 - 1e-9) GROUP BY doc_id, item_id""",
    }
