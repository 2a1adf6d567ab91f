"""Tree-shaped chat exports and logs as rows of nodes, walked by pointer doubling in place of a Python call for each file."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sanitise_id
from ..operators.chains import walk
from . import ingest

_EXPORT = "array<struct<id:string,uuid:string,title:string,name:string,current_node:string,mapping:map<string,struct<parent:string,message:string>>>>"
_SAID = "name string, ts double, content string, hidden boolean"


def _parts(messages: pd.Series) -> pd.DataFrame:
    rows = []
    for text in messages:
        try:
            m = json.loads(text) if text else {}
        except ValueError:
            m = {}
        m = m if isinstance(m, dict) else {}
        author, about = (x if isinstance(x, dict) else {} for x in (m.get("author"), m.get("metadata")))
        rows.append((None if author.get("role") is None else str(author["role"]), ingest.seconds(m.get("create_time")), ingest.flatten_text(m.get("content")), bool(about.get("is_visually_hidden_from_conversation")) or not m))
    return pd.DataFrame(rows, columns=["name", "ts", "content", "hidden"])


def _said(message: str) -> Column:
    return F.pandas_udf(_parts, _SAID)(message)


def chat_trees(files: DataFrame) -> DataFrame:
    """chain (file and number in it), id, title, current, node, parent, message (JSON) of exports (path, payload) whose
    conversations are maps of nodes. What is no JSON, or of another shape, gives none."""
    listed = F.when(F.ltrim("payload").startswith("{"), F.concat(F.lit("["), F.col("payload"), F.lit("]"))).otherwise(F.col("payload"))
    convs = files.select("path", F.posexplode(F.from_json(listed, _EXPORT)).alias("n", "c")).filter("c.mapping IS NOT NULL")
    named = F.coalesce(F.nullif(F.col("c.id"), F.lit("")), F.nullif(F.col("c.uuid"), F.lit("")), F.concat_ws("-", "path", "n"))
    rows = convs.select(F.concat_ws("#", "path", "n").alias("chain"), named.alias("id"), F.coalesce("c.title", "c.name").alias("title"), F.col("c.current_node").alias("current"), "n", F.explode("c.mapping").alias("node", "x"))
    return rows.select("chain", "id", "title", "current", (F.col("n").cast("long") * (1 << 32)).alias("base"), "node", F.col("x.parent").alias("parent"), F.col("x.message").alias("message"))


def chat_sessions(files: DataFrame) -> DataFrame:
    """session_id, title, ordinal, role, ts, content of those conversations: the messages from the root to the current
    node; where that is none of the nodes, all of them by time (then by node). Hidden and blank messages and unknown speakers are left out. No task
    holds a walked conversation; one without a current node is sorted by time in one."""
    nodes = chat_trees(files)
    there = nodes.select("chain", F.col("node").alias("to"))
    pointers = nodes.select("chain", "node", F.col("parent").alias("to")).join(there, ["chain", "to"], "left_semi")
    starts = nodes.filter("node = current").select("chain", "node")
    chain = walk(pointers, starts)
    ends = chain.groupBy("chain").agg(F.max("place").alias("end"))
    # The walk went from the current node up to the root, so the root's place is the greatest.
    walked = nodes.join(chain, ["chain", "node"]).join(ends, "chain").withColumn("ordinal", F.col("base") + F.col("end") - F.col("place")).drop("place", "end")
    rest = nodes.join(ends, "chain", "left_anti").withColumn("m", _said("message"))
    timed = rest.withColumn("ordinal", F.col("base") + F.row_number().over(W.partitionBy("chain").orderBy("m.ts", "node")) - 1)
    ranked = walked.withColumn("m", _said("message")).unionByName(timed).filter("NOT m.hidden")
    role = ingest.role_of(F.col("m.name"))
    return ranked.filter(role.isNotNull() & (F.trim(F.regexp_replace("m.content", r"\s", " ")) != "")).select(sanitise_id(F.col("id")).alias("session_id"), "title", "ordinal", role.alias("role"), F.col("m.ts").alias("ts"), F.col("m.content").alias("content"))


def active_branch(entries: DataFrame) -> DataFrame:
    """Of tree-shaped logs (path, line, id, parent, and what else) the branch that follows each entry's last child from
    the root on, with `depth`."""
    last = entries.groupBy(F.col("path").alias("chain"), "parent").agg(F.max_by("id", "line").alias("to"))
    starts = last.filter("parent IS NULL").select("chain", F.col("to").alias("node"))
    found = walk(last.filter("parent IS NOT NULL").select("chain", F.col("parent").alias("node"), "to"), starts)
    return entries.join(found.select(F.col("chain").alias("path"), F.col("node").alias("id"), F.col("place").cast("int").alias("depth")), ["path", "id"])
