"""The operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.llm import (
    decontaminate,
    exact_dedup,
    fill_middle,
    language,
    line_dedup,
    ngram_join,
    pii,
    sentencepiece_viterbi,
    simhash_join,
    token_counts,
    token_store,
    toxicity,
    vector_codes,
)
from meibo.llm.ship import ship
from meibo.operators.staging import new_path

QUERIES = {}
ORACLE_SQL = {}


def query(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_dedup(spark, sf_dir):
    """Every page without the boilerplate lines of its host."""
    done = line_dedup.drop_site_lines_of_html(table(spark, sf_dir, "pages"), carry=["page_id"])
    return done.select("page.page_id", "host", "n_lines", "n_dropped", "clean_text")


ORACLE_SQL["op1_line_dedup"] = f"""
with shown as (
  select page_id, lower(regexp_extract(coalesce(url, ''), '{line_dedup.HOST}', 1)) as host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '{line_dedup.HIDDEN}', chr(10), 'g'), '{line_dedup.BLOCKS}', chr(10), 'g'), '{line_dedup.TAGS}', '', 'g') as body
  from pages
), split as (
  select row_number() over () as row, page_id, host, string_split_regex(
    trim(body, ' ' || chr(9) || chr(10) || chr(13)), '{line_dedup.BREAKS}') as lines
  from shown
), placed as (
  select * from (select row, host, unnest(lines) as line, generate_subscripts(lines, 1) as place from split)
  where line <> ''
), frequent as (
  select host, line from placed group by host, line
  having count(distinct row) >= {line_dedup.MIN_PAGES}
    and count(distinct row) > {line_dedup.MAX_RATIO} * (select count(*) from split s where s.host = placed.host)
), marked as (
  select p.*, f.line is not null as dropped
  from placed p left join frequent f on p.host = f.host and p.line = f.line
), joined as (
  select row, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
    string_agg(line, chr(10) order by place) filter (not dropped) as clean_text
  from marked group by row
)
select page_id, host, cast(coalesce(n_lines, 0) as int) as n_lines, cast(coalesce(n_dropped, 0) as int) as n_dropped,
  coalesce(clean_text, '') as clean_text
from split left join joined using (row)
"""


@query
def op3_exact_dedup(spark, sf_dir):
    """Every document with the id of the copy that stays."""
    return exact_dedup.mark_exact_copies(table(spark, sf_dir, "documents"))


ORACLE_SQL["op3_exact_dedup"] = """
with rows as (
  select doc_id, sha256(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
from rows window g as (partition by text_sha256)
"""


@query
def op10_toxicity(spark, sf_dir):
    """Score and offending sentences of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.model_for(docs, table(spark, sf_dir, "labels"))
    done = toxicity.score_documents(docs, model)
    return done.select("doc_id", "held_out", "score", "predicted", "offending")


@query
def op5_ngram_jaccard_join(spark, sf_dir):
    """Every document with its class of copies, its links and its group of near copies."""
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


@query
def op6_benchmark_decontamination(spark, sf_dir):
    """Every document with the benchmark items that it contains."""
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_pii(spark, sf_dir):
    """Every document with its counts of personal data and the digests of their places."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    base = F.filter("spans", lambda s: s.kind.isin(*pii.BASE_KINDS))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


@query
def op2_language_id(spark, sf_dir):
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.model_for(docs))


@query
def op9_sentencepiece(spark, sf_dir):
    """Ids of every document, and whether decoding gives its text back."""
    return sentencepiece_viterbi.encode_documents(table(spark, sf_dir, "documents"))


@query
def op7_token_ids(spark, sf_dir):
    """Where every document's ids lie in the token store, read back from it."""
    return token_store.read_token_store(token_store.write_token_store(table(spark, sf_dir, "documents")))


@query
def op8_token_counts(spark, sf_dir):
    """Totals after estimates were inserted, revised to exact counts, and exact copies deleted."""
    docs, version = table(spark, sf_dir, "documents"), "byte_bpe_50k"
    row = token_counts.row_digest(F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars"))
    rollup = token_counts.TokenRollup(spark, new_path(spark, "token-rollup"))
    rollup.commit("1-estimate", token_counts.insert_of(docs, version, F.ceil(F.col("n_chars") / 4), row), "row")
    exact = token_counts.insert_of(docs, version, token_counts.token_count(F.col("text")), row)
    rollup.commit("2-count", exact, "row")
    copies = exact_dedup.mark_exact_copies(docs, carry=[row.alias("row")]).where("not kept")
    rollup.commit("3-dedup", token_counts.delete_of(copies, version, F.col("row")), "row")
    rollup.commit("2-count", exact, "row")
    return rollup.totals()


@query
def op11_simhash(spark, sf_dir):
    """Fingerprint of every document, and the smallest id that links of near fingerprints reach."""
    return simhash_join.near_copies(table(spark, sf_dir, "documents"))


@query
def op12_vector_codes(spark, sf_dir):
    """Code of every vector, its error and its label's, and the digest of the codebooks."""
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.fit(vectors)
    done = vector_codes.with_label_error(vector_codes.encode(vectors, books))
    digest = F.lit(books.sha256() if books else None).cast("string")
    return done.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def _codes_sql(k: int) -> str:
    """The nearest entry of codebook ``k`` for every part."""
    return f"""
codes{k} as (
  select r, part, arg_min(entry, (d, entry)) as entry, min(d) as d from (
    select x.r, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) as d
    from cells x join book{k} b using (part, pos) group by all)
  group by all
)"""


def _book_sql(k: int) -> str:
    """Codebook ``k``, from the codes of the one before."""
    return f"""
book{k} as (
  select b.part, b.entry, b.pos, coalesce(m.v, b.v) as v from book{k - 1} b left join (
    select c.part, c.entry, x.pos, cast(floor(sum(x.v) / count(*)) as bigint) as v
    from codes{k - 1} c join cells x using (r, part) group by all) m using (part, entry, pos)
)"""


ORACLE_SQL["op12_vector_codes"] = f"""
with kept as (
  select row_number() over (order by vec_id, embedding) as r, vec_id, label, embedding from embeddings
  where embedding is not null and list_bool_and([x is not null and isfinite(x) for x in embedding])
), numbers as (
  select r, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i, len(embedding) // {vector_codes.PARTS} as size from kept
), cells as (
  select r, i // size as part, i % size as pos, cast(floor({vector_codes.SCALE} * cast(x as double)) as bigint) as v from numbers
), book0 as (
  select part, r - 1 as entry, pos, v from cells where r <= {vector_codes.ENTRIES}
),{_codes_sql(0)},{_book_sql(1)},{_codes_sql(1)},{_book_sql(2)},{_codes_sql(2)}, coded as (
  select r, string_agg(format('{{:02x}}', entry), '' order by part) as code, cast(sum(d) as bigint) as error from codes2 group by r
), books as (
  select sha256(string_agg(cast(v as varchar), ',' order by part, entry, pos)) as digest from book2
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, digest as codebooks_sha256
from kept join coded using (r), books
"""


@query
def op13_fill_in_middle(spark, sf_dir):
    """Every document with its parts moved, and the digests of the moved and of the rebuilt text."""
    moved = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    rebuilt = fill_middle.restore(moved.withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256)))
    return rebuilt.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256")
    )


ORACLE_SQL["op13_fill_in_middle"] = f"""
with cut as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), 'null')) as h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units
  from documents
), numbered as (
  select *, len(units) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
    cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
  from cut
), placed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= {fill_middle.RATE}
      then 'plain' when h4 % 100 < {fill_middle.SPM_RATE} then 'spm' else 'psm' end as form
  from numbered
), parts as (
  select *, array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m, array_to_string(units[b + 1:], '') as s
  from placed
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(case when form = 'plain' then text else p || m || s end) as restored_sha256
from parts
"""
