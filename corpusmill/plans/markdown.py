"""Conversations written as Markdown, and the chunks and elements of that."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import structure as T
from corpusmill.plans.registry import query
from corpusmill.session import table

#: A text for each conversation: front matter for even ones, a heading, the words, code with a hash in it, a list, a table and a link for each turn; odd ones end in open code.
_TEXT = """m as materialized (select conv_id, case when conv_id % 2 = 0 then '---' || chr(10) || 'id: ' || conv_id || chr(10) || '---' || chr(10) else '' end
|| string_agg(repeat('#', (turn % 7 + 1)::int) || ' ' || role || chr(10) || text || chr(10) || chr(10) || '```sql' || chr(10) || '# ' || turn || chr(10) || '```' || chr(10) || '- [a](b) ![c](d)' || chr(10) || '| x | y |' || chr(10) || '> said', chr(10) order by turn)
|| case when conv_id % 2 = 1 then chr(10) || '``` js' || chr(10) || 'x' else '' end as text from conversations where text is not null group by conv_id),
l0 as (select conv_id, i - 1 as i, s[i] as line, s from (select conv_id, string_split(text, chr(10)) as s, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from m)),
l1 as (select *, case when rtrim(s[1]) = '---' then list_position(list_transform(s[2:], lambda x: rtrim(x)), '---') else 0 end as front from l0),
l2 as (select conv_id, i, line, sum(starts_with(line, '```')::int) over (partition by conv_id order by i) as f from l1 where i > coalesce(front, 0) - (case when coalesce(front, 0) = 0 then 1 else 0 end)),
l as materialized (select *, starts_with(line, '```') or f % 2 = 1 as code, starts_with(line, '#') and not (starts_with(line, '```') or f % 2 = 1) as head from l2)"""
_STRIP = lambda x: f"regexp_replace({x}, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"
_LEVEL = "least(6, length(regexp_extract(line, '^#*', 0)))"
_HEADS = f"select conv_id, 'heading' as kind, {_STRIP(chr(40) + 'regexp_replace(line, ' + chr(39) + '^#{1,6}' + chr(39) + ', ' + chr(39) * 2 + '))')} as content, {_LEVEL} as level, null::varchar as language, i + 1 as line from l where head"


def texts(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    nl = F.lit("\n")
    turn = F.concat(F.expr("repeat('#', cast(turn % 7 + 1 as int))"), F.lit(" "), F.col("role"), nl, F.col("text"), nl, nl, F.lit("```sql"), nl, F.lit("# "), F.col("turn").cast("string"), nl, F.lit("```"), nl, F.lit("- [a](b) ![c](d)"), nl, F.lit("| x | y |"), nl, F.lit("> said"))
    g = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    front = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("---\nid: "), F.col("conv_id").cast("string"), F.lit("\n---\n"))).otherwise("")
    return g.select("conv_id", F.concat(front, F.col("t"), F.when(F.col("conv_id") % 2 == 1, "\n``` js\nx").otherwise("")).alias("text"))


@query(f"with {_TEXT} {_HEADS}")
def markdown_by_heading(spark, d):
    return T.markdown_chunks(texts(spark, d), "conv_id", "text", "heading")


@query(f"""with {_TEXT}, s as (select *, sum(head::int) over (partition by conv_id order by i) as s from l), g as (select conv_id, s, {_STRIP("coalesce(string_agg(line, chr(10) order by i) filter (not head), '')")} as content, coalesce(max({_LEVEL}) filter (head), 0) as level, min(i) + 1 as line from s group by 1, 2)
{_HEADS} union all select conv_id, 'section', content, level, null, line from g where content <> ''""")
def markdown_by_section(spark, d):
    return T.markdown_chunks(texts(spark, d), "conv_id", "text", "section")


@query(f"""with {_TEXT}, s as (select *, sum(({_STRIP('line')} = '')::int) over (partition by conv_id order by i) as s from l)
select conv_id, case when arg_min(head, i) then 'heading' else 'paragraph' end as kind, {_STRIP("string_agg(line, chr(10) order by i)")} as content, 0 as level, null::varchar as language, min(i) + 1 as line from s where {_STRIP('line')} <> '' group by conv_id, s""")
def markdown_by_paragraph(spark, d):
    return T.markdown_chunks(texts(spark, d), "conv_id", "text", "paragraph")


@query(f"""with {_TEXT}, k as (select *, (f + 1) // 2 as k from l where code)
{_HEADS} union all select conv_id, 'text', line, 0, null, i + 1 from l where not code and not head and {_STRIP('line')} <> ''
union all select conv_id, 'code', coalesce(string_agg(line, chr(10) order by i) filter (not starts_with(line, '```')), ''), 0, {_STRIP("substr(arg_min(line, i), 4)")}, min(i) + 1 from k group by conv_id, k having count(*) > 1""")
def markdown_by_block(spark, d):
    return T.markdown_chunks(texts(spark, d), "conv_id", "text", "block")


_COUNTS = ", ".join(f"sum(case when code then 0 else len(regexp_extract_all(line, '{p.replace('(?<!!)', '')}')) end)::bigint as {n}" for n, p in T.ELEMENTS.items())


@query(f"with {_TEXT}, c as (select conv_id, sum(head::int)::bigint as headings, ceil(max(f) / 2)::bigint as code_blocks, {_COUNTS} from l group by 1) select * replace (links - images as links) from c")
def markdown_elements(spark, d):
    return T.markdown_elements(texts(spark, d), "conv_id", "text")
