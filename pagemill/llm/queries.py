"""One registered query for each operator, with production parameters, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from . import bpe, decontaminate, exact, lexical, phrases, quality, repeats, simhash, token_counts, token_files, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    # Where the package isn't installed, the workers of a local session find it beside this file.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_quality(spark, d):
    """Quality score of every text; every fourth document is held out of the fit."""
    documents, labels = table(spark, d, "documents"), table(spark, d, "labels")
    out = quality.held_out(F.col("doc_id"), 4, 2)
    model = quality.fit(documents, labels.where(~out), "quality")
    rows = quality.scored(documents.select("doc_id", "text"), model, "score")
    predicted = F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0)
    return rows.select("doc_id", out.alias("held_out"), "score", predicted.alias("predicted"))


@query
def op2_decontaminate(spark, d):
    """Words of every document that lie in a window of ten benchmark words."""
    hits = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return hits.drop("hit_words")


ORACLES["op2_decontaminate"] = r"""
with item as (
    select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), doc as (
    select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
    from documents
), item_window as (
    select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as txt
    from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from item where len(w) > 0)
), doc_window as (
    select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as txt
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, (select distinct n from item_window) where len(w) >= n)
), hit as (
    select doc_id, d.n, i, item_id from doc_window d join item_window using (n, txt)
), hit_word as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id
), hit_item as (
    select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
    from (select distinct doc_id, item_id::varchar as id from hit) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit_word using (doc_id) left join hit_item using (doc_id)
"""


@query
def op3_warc(spark, d):
    """Every page written into seekable archives and read back from them."""
    pages = table(spark, d, "pages")
    archive = warc.write_archive(pages, new_folder(spark, "archive"))
    return warc.read_archive(spark, archive).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLES["op3_warc"] = """
with p as (
    select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages
), f as (
    select *, min(page_id) over (partition by body) as first_id from p
)
select page_id, octet_length(encode(body))::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(hex, (5 * (i // 4) + 1)::int, 5))::int) >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from f
"""


@query
def op4_bpe(spark, d):
    """Ids of every text, and the text decoded from them again."""
    return bpe.encode_documents(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_token_counts(spark, d):
    """Number of tokens of every text."""
    return token_counts.count_tokens(
        table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512
    )


@query
def op6_simhash(spark, d):
    """Fingerprint and component of near copies of every document."""
    return simhash.near_copies(table(spark, d, "documents"))


@query
def op7_token_files(spark, d):
    """Ids of every text written to Parquet in document order, and read from there."""
    folder = new_folder(spark, "tokens")
    token_files.write_token_ids(
        table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2
    )
    return token_files.token_digest(spark, folder)


@query
def op8_repeats(spark, d):
    """Bytes of every text within a string of 200 bytes that occurs more than once."""
    return repeats.repeats(table(spark, d, "documents"))


@query
def op9_toxicity(spark, d):
    """Toxicity score of every text; every third document is held out of the fit."""
    documents, labels = table(spark, d, "documents"), table(spark, d, "labels")
    out = quality.held_out(F.col("doc_id"), 3, 1)
    rows = toxicity.toxicity(documents, labels.where(~out), "toxic")
    predicted = F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0)
    return rows.select("doc_id", out.alias("held_out"), "score", predicted.alias("predicted"), "evidence")


@query
def op10_topk(spark, d):
    """Every vector whose id is divisible by 50 against all vectors."""
    vectors = table(spark, d, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


ORACLES["op10_topk"] = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as ints
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id,
           list_sum(list_transform(list_zip(q.ints, c.ints), lambda p: p[1] * p[2]))::bigint as score
    from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank
    from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


@query
def op11_lexical_search(spark, d):
    """The ten best documents for every benchmark item."""
    return lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"), k=10)


ORACLES["op11_lexical_search"] = r"""
with doc as (
    select row_number() over () as r, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
), total as (
    select count(*)::bigint as n_docs, sum(len(terms))::bigint as n_terms from doc where len(terms) > 0
), posting as (
    select r, doc_id, n, term, count(*)::bigint as tf
    from (select r, doc_id, len(terms)::bigint as n, unnest(terms) as term from doc) group by all
), asked as (
    select q, item_id, term, count(*)::bigint as times
    from (select row_number() over () as q, item_id,
                 unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)
    group by all
), weighted as (
    select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
    from posting, total group by term, n_docs
), scored as (
    select q, item_id, r, doc_id,
           sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint as score
    from asked join weighted using (term) join posting using (term), total
    group by q, item_id, r, doc_id
), ranked as (
    select *, row_number() over (partition by q order by score desc, doc_id nulls last)::int as rank
    from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""


@query
def op12_exact_dedup(spark, d):
    """Groups of texts that are equal but for runs of white space."""
    return exact.duplicates(table(spark, d, "documents"))


ORACLES["op12_exact_dedup"] = r"""
with t as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
), g as (
    select *, row_number() over (partition by norm order by doc_id nulls last) as place,
           count(*) over (partition by norm) as n, min(doc_id) over (partition by norm) as keep_id
    from t
)
select doc_id, keep_id, n::bigint as group_size, place = 1 as kept, sha256(norm) as text_sha256 from g
"""


@query
def op13_collocations(spark, d):
    """The 2,000 strongest phrases of two or three words of each language."""
    return phrases.collocations(table(spark, d, "documents"))


ORACLES["op13_collocations"] = r"""
with piece as (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) as p
    from documents
), words as (
    select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece
), gram as (
    select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*)::bigint as f
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i
          from words, (select unnest([1, 2, 3]) as k) where len(w) >= k)
    group by all
), total as (
    select lang, sum(f)::bigint as n from gram where k = 1 group by lang
), candidate as (
    select lang, k, phrase, f as a, string_split(phrase, ' ') as w from gram where k > 1 and f >= 10
), cut as (
    select c.lang, c.k, c.phrase, c.a, j, x.f as l, y.f as r,
           ((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f))::bigint as score
    from (select *, unnest(range(1, k)) as j from candidate) c
    join gram x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : j], ' ')
    join gram y on y.lang = c.lang and y.phrase = array_to_string(c.w[j + 1 : c.k], ' ')
), lowest as (
    select * from (select *, row_number() over (partition by lang, phrase order by score, j) as o from cut) where o = 1
), covered as (
    select lang, part, max(a) as longer
    from (select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as part from candidate where k = 3) group by all
), ranked as (
    select l.*, row_number() over (partition by l.lang order by score desc, a desc, encode(l.phrase)) as rank
    from lowest l left join covered v on v.lang = l.lang and v.part = l.phrase
    where longer is null or 100 * longer < 50 * a
)
select lang, rank::bigint as rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000
"""
