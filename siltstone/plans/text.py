"""Full-text search and functions."""

from pyspark.sql import functions as F

from ..operators import fts, udf
from ..session import prepare, table
from .registry import query

_TOKENS = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{Nd}\s]', '', 'g'), '\s+'), lambda x: x <> ''))"


def _has(term):
    return f"list_contains(t, '{term}')"


def _fts(name, q, where, more="", tokens=_TOKENS, tokenizer="simple"):
    @query(name, f"SELECT doc_id FROM (SELECT doc_id, lang, {tokens} AS t FROM documents) WHERE ({where}){more}")
    def run(spark, d):
        docs = table(spark, d, "documents")
        if more:
            docs = docs.where(more.removeprefix(" AND "))
        return fts.search(docs, ["text"], q, tokenizer).select("doc_id")

    run.__name__ = name


_fts("q_fts_term", "with", _has("with"))
_fts("q_fts_and", "the AND with AND by", f"{_has('the')} AND {_has('with')} AND {_has('by')}")
_fts("q_fts_implicit_and", "the with", f"{_has('the')} AND {_has('with')}")
_fts("q_fts_or", "with OR los", f"{_has('with')} OR {_has('los')}")
_fts("q_fts_not", "the NOT with", f"{_has('the')} AND NOT {_has('with')}")
_fts("q_fts_complex", "the AND NOT with OR los AND que OR und NOT der", f"{_has('the')} AND NOT {_has('with')} OR {_has('los')} AND {_has('que')} OR {_has('und')} AND NOT {_has('der')}")
_fts("q_fts_residual", "the AND by", f"{_has('the')} AND {_has('by')}", " AND lang = 'fr'")


def _stem_sql():
    """The stemmer's rules as one CASE for DuckDB."""
    when = " ".join(
        f"WHEN strlen(w) > {len(s) + 2} AND ends_with(w, '{s}') THEN left(w, length(w) - {len(s)}) || '{i}'" for s, i in fts.RULES
    )
    return f"list_transform({_TOKENS}, lambda w: CASE WHEN strlen(w) <= 3 THEN w {when} ELSE w END)"


_fts("q_fts_porter", "tion OR heed NOT with", f"{_has(fts.stem_text('tion'))} OR {_has(fts.stem_text('heed'))} AND NOT {_has('with')}", tokens=_stem_sql(), tokenizer="porter")


@query("q_fts_index", f"SELECT token, count(*) AS documents FROM (SELECT unnest({_TOKENS}) AS token FROM documents WHERE lang IS DISTINCT FROM 'de') GROUP BY token")
def q_fts_index(spark, d):
    """Posting sizes of all tokens after the documents of one language were removed from an index."""
    docs = table(spark, d, "documents")
    stored = fts.remove_documents(fts.index(docs, "doc_id", ["text"]), docs.where("lang = 'de'"), "doc_id")
    return fts.postings(stored, "doc_id")


def _udf(name, create, call, sql, source="part"):
    fn = udf.parse_create(create)[0]
    key = {"part": "p_partkey", "orders": "o_orderkey"}[source]

    @query(name, f"SELECT {key}, {sql} AS v FROM {source}")
    def run(spark, d):
        udf.create_function(prepare(spark), create)
        return table(spark, d, source).select(key, F.expr(f"{fn}({call})").alias("v"))

    run.__name__ = name


_udf("q_udf_expr", "CREATE FUNCTION sil_add(a INT, b INT) RETURNS INT AS $$ a + b * 2 $$ LANGUAGE SQL", "p_size, 3", "p_size::BIGINT + 6")
_udf(
    "q_udf_if",
    "CREATE FUNCTION sil_grade(score INT) RETURNS TEXT AS $$ BEGIN IF score >= 40 THEN RETURN 'A'; ELSIF score >= 25 THEN RETURN 'B'; ELSE RETURN 'D'; END IF; END; $$ LANGUAGE SQL",
    "p_size",
    "CASE WHEN p_size >= 40 THEN 'A' WHEN p_size >= 25 THEN 'B' ELSE 'D' END",
)
_udf("q_udf_recursive", "CREATE FUNCTION sil_fact(n INT) RETURNS INT AS $$CASE WHEN n <= 1 THEN 1 ELSE n * sil_fact(n - 1) END$$", "p_size % 15", "factorial((p_size % 15)::INT)::BIGINT")
_udf(
    "q_udf_for",
    "CREATE FUNCTION sil_sum_to(n INT) RETURNS INT AS $$ BEGIN DECLARE s INT := 0; FOR i IN 1..n LOOP s := s + i; END LOOP; RETURN s; END; $$",
    "p_size",
    "(p_size * (p_size + 1) // 2)::BIGINT",
)
_udf(
    "q_udf_while",
    "CREATE FUNCTION sil_digits(n INT) RETURNS INT AS $$ BEGIN DECLARE k INT := 0; WHILE n > 0 LOOP n := n / 10; k := k + 1; END LOOP; RETURN k; END; $$",
    "o_orderkey",
    "CASE WHEN o_orderkey = 0 THEN 0 ELSE length(o_orderkey::VARCHAR) END::BIGINT",
    "orders",
)
_udf(
    "q_udf_loop_exit",
    "CREATE FUNCTION sil_pow2(n INT) RETURNS INT AS $$ BEGIN DECLARE p INT := 1; LOOP EXIT WHEN p >= n; p := p * 2; END LOOP; RETURN p; END; $$",
    "p_size",
    "(2 ** ceil(log2(p_size)))::BIGINT",
)
