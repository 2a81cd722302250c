"""Derived views that stand in for extraction tables: one SQL text for Spark and for DuckDB.

Braces name the tables and views that a view reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_boxes": """
select l_orderkey as page_id,
       cast(row_number() over (partition by l_orderkey
            order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) as box_idx,
       cast(l_partkey % 25 as int) as cls_id,
       cast(cast(floor(l_extendedprice) as bigint) % 1000 as double) / 1000e0 as score,
       cast(l_suppkey % 20 as int) * 20 as x1,
       cast(l_partkey % 30 as int) * 20 as y1,
       cast(l_suppkey % 20 as int) * 20 + 4 + cast(l_quantity as int) * 8 as x2,
       cast(l_partkey % 30 as int) * 20 + 4 + cast(l_partkey % 7 as int) * 60 as y2,
       l_linenumber as read_order
from {lineitem}""",
    "v_page_dim": """
select distinct l_orderkey as page_id, 600 as width, 800 as height from {lineitem}""",
    "v_page_runs": """
select cast(user_id % 4 as int) as run_id, concat('p', cast(event_id as string), '.png') as image,
       case when event_type = 'error' then concat('failed: e', cast(event_id % 5 as string))
            when event_type = 'signup' and event_id % 10 = 0 then 'fallback: timeout'
            else 'ok' end as status,
       value as seconds, event_type as stage
from {events}""",
    "v_intervals": """
select user_id as page_id, cast((event_id * 37) % 997 as double) as start_s,
       cast((event_id * 37) % 997 as double) + floor(value) as finish_s
from {events}""",
    "v_pred_ref": """
select doc_id as stem, text from {documents} where doc_id % 17 <> 0""",
    "v_pred_cand": """
select doc_id as stem,
       case when doc_id % 7 = 0 then concat(text, chr(10))
            when doc_id % 11 = 0 then concat(text, ' changed') else text end as text
from {documents} where doc_id % 13 <> 0""",
    "v_trace_ref": """
select conv_id as page, turn as block_index, role as label, text as raw_result from {conversations}""",
    "v_trace_cand": """
select conv_id as page, turn as block_index,
       case when (conv_id + turn) % 9 = 0 then 'other' else role end as label,
       case when (conv_id * 7 + turn) % 10 = 0 then concat(text, 'x') else text end as raw_result
from {conversations} where conv_id % 23 <> 0 and (conv_id + turn) % 31 <> 0""",
    "v_samples_ref": """
select case when l.l_linenumber % 2 = 0 then 'formula' else 'table' end as component,
       l.l_orderkey as img_id, l.l_linenumber as gt_idx,
       row_number() over (partition by l.l_orderkey
            order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) as gt_position,
       p.p_name as gt, p.p_name as pred, 1e0 - l.l_discount as score
from {lineitem} l join {part} p on l.l_partkey = p.p_partkey""",
    "v_samples_cand": """
select component, img_id, gt_idx, gt_position, gt,
       case when img_id % 5 = 0 then concat(gt, ' x') when img_id % 8 = 0 then '' else gt end as pred,
       case when img_id % 8 = 0 then 0e0 when img_id % 5 = 0 then score * 0.9e0 else score end as score
from {v_samples_ref} where img_id % 29 <> 0""",
    "v_manifest": """
select source as category, concat('doc', cast(doc_id as string), '.png') as image from {documents}""",
    "v_otsl": """
select l_orderkey as table_id, l_linenumber as seq,
       concat(case when l_partkey % 5 = 0 then '<ecel>' else concat('<fcel>', cast(l_partkey as string)) end,
              case when l_suppkey % 4 = 0 then '<lcel>' else '' end,
              case when l_suppkey % 3 = 0 then '<nl>' else '' end) as piece
from {lineitem}""",
    "v_blocks": """
select page_id, box_idx as idx,
       case cls_id % 8 when 0 then 'table' when 1 then 'image' when 2 then 'paragraph_title' when 3 then 'number'
            when 4 then 'doc_title' else 'text' end as label,
       case when cls_id % 7 = 0 then '' when cls_id % 8 = 2 then concat(cast(cls_id as string), '.', cast(box_idx as string), ' Title part.')
            else concat('Line ', cast(box_idx as string), '-', chr(10), 'next ', cast(cls_id as string), chr(10), chr(10), 'last') end as content,
       x1, y1, x2, y2
from {v_boxes}""",
    "v_otsl_text": """
select table_id, listagg(piece, '') within group (order by k) as text from (select table_id, piece, concat(lpad(cast(seq as string), 4, '0'), piece) as k from {v_otsl}) group by table_id""",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"{(\w+)}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view over the tables in sf_dir."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in _names(sql)})


def oracle(body: str) -> str:
    """DuckDB SQL of a body that names views in braces: views become common table expressions."""
    ctes: dict[str, str] = {}

    def add(sql: str) -> None:
        for n in _names(sql):
            if n in VIEWS and n not in ctes:
                add(VIEWS[n])
                ctes[n] = re.sub(r"{(\w+)}", r"\1", VIEWS[n])

    add(body)
    text = re.sub(r"{(\w+)}", r"\1", body).strip()
    if not ctes:
        return text
    # the one aggregate whose name differs
    ctes = {n: re.sub(r"listagg\((\w+), ''\) within group \(order by (\w+)\)", r"string_agg(\1, '' order by \2)", s) for n, s in ctes.items()}
    heads = ", ".join(f"{n} AS ({s.strip()})" for n, s in ctes.items())
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(head):
            return f"{head}{heads}, {text[len(head):]}"
    return f"WITH {heads} {text}"
