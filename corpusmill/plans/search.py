"""Full-text queries over an inverted index of `documents`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.functions.stem import STOP, stem_sql
from corpusmill.operators import search as S
from corpusmill.plans.registry import query
from corpusmill.session import table
from corpusmill.streaming.jobs import shared

#: Queries of the report: plural and inflected forms, stop words, a word that no text has.
ASKED = ["licensed under the License", "licenses", "copies of documentation", "permissions are granted", "all the conditions", "unheardofword license", "of the"]

_STOP = ", ".join(f"'{w}'" for w in STOP)
_TOKENS = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query(f"""with asked as (select * from (values {", ".join(f"('{q}')" for q in ASKED)}) v(query)),
tokens as materialized (select distinct doc_id, unnest({_TOKENS.format(t="text")}) as word from documents where text is not null), wanted as (select distinct query, unnest({_TOKENS.format(t="query")}) as word from asked),
words as (select distinct word from (select word from tokens union all select word from wanted) where word not in ({_STOP})), stems as materialized ({stem_sql("words", "word", "term")}),
q as (select distinct query, term from wanted join stems using (word)), p as (select distinct doc_id, term from tokens join stems using (word)),
n as (select query, count(*) as wanted from q group by 1), h as (select query, doc_id, count(*) as n from q join p using (term) group by all)
select query, doc_id from h join n using (query) where n = wanted""")
def fulltext_stemmed(spark, d):
    """Documents that hold all words of a query, by their stems, read from an index."""
    path = f"{shared(spark)}/search-{uuid.uuid4().hex}"
    S.build(table(spark, d, "documents").where(F.col("doc_id").isNotNull()), "doc_id", "text", path)
    queries = spark.createDataFrame([(q, q) for q in ASKED], "query string, text string")
    return S.matching_all(spark, path, queries, "query", "text").select("query", F.col("key").alias("doc_id"))
