"""Queries for sources, sinks, the engine's commands and the streams, on the driver's tables.

What a source reads is written first: tables become transcripts, log files or stream inputs in the shared folder. Each is compared with the
same rows in SQL, so that writing and reading lose and change nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import duplicates, embedding, executions, log, store
from .plans import checkpoints
from .plans.engine import MemoryEngine
from .queries import _RES, _TURNS, C, M, chunks, messages, observations, query, table
from .schema import EXECUTION, V1_CHUNK
from .session import scratch
from .sources import hooks, lines, logs, pending, transcripts
from .streaming import checkpoints as streams

NOW = datetime(2026, 4, 5, 6)


def written(df: DataFrame, *order: str, name: str) -> str:
    """The column value of df as text files in the shared folder, rows of one first column together and in order."""
    where = scratch(df.sparkSession, name)
    df.repartition(4, order[0]).sortWithinPartitions(*order).select("value").write.text(where)
    return where


# --- transcripts


def _transcripts(spark: SparkSession, d: str) -> str:
    """Conversations as transcripts: an assistant's message uses a tool, and the next line is a user's message with its result; system messages are summaries."""
    m = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("sessionId"), F.col("turn").alias("no"), "role", "text")
    tool = F.concat(F.lit("t"), F.col("no").cast("string"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    line = lambda kind, content, *more: F.to_json(F.struct(F.lit(kind).alias("type"), "sessionId", message(kind, content).alias("message"), *more))
    said = F.array(F.struct(F.lit("text").alias("type"), "text", *[F.lit(None).cast("string").alias(c) for c in ("id", "name")], F.lit(None).cast("struct<command:string>").alias("input")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), tool.alias("id"), F.lit("Bash").alias("name"), F.struct(F.concat(F.lit("run "), F.col("no").cast("string")).alias("command")).alias("input")))
    result = F.array(F.struct(F.lit("tool_result").alias("type"), tool.alias("tool_use_id"), F.concat(F.lit("out "), F.col("no").cast("string")).alias("content"), (F.col("no") % 4 == 1).alias("is_error")))
    own = m.select("sessionId", (F.col("no") * 2).alias("place"), F.when(F.col("role") == "user", line("user", F.col("text"))).when(F.col("role") == "assistant", line("assistant", said)).otherwise(line("user", F.col("text"), F.lit(True).alias("isCompactSummary"))).alias("value"))
    results = m.where("role = 'assistant'").select("sessionId", (F.col("no") * 2 + 1).alias("place"), line("user", result).alias("value"))
    return written(own.unionByName(results), "sessionId", "place", name="transcripts")


@query("SELECT conv_id::VARCHAR AS session, role, sha256(CASE role WHEN 'assistant' THEN CASE WHEN text <> '' THEN text || chr(10) ELSE '' END || '[Tool: Bash] run ' || turn || chr(10) || 'out ' || turn ELSE text END) AS hash FROM conversations WHERE role = 'assistant' OR role = 'user' AND text <> ''")
def transcript_scan(spark, d):
    m, u, r = transcripts.read_transcripts(spark, _transcripts(spark, d))
    return transcripts.with_tools(m, u, r).select("session", "role", F.sha2("text", 256).alias("hash"))


@query("SELECT conv_id::VARCHAR AS session, 'run ' || turn AS command, CASE WHEN turn % 4 = 1 THEN 'failed' ELSE 'succeeded' END AS status, 'out ' || turn AS output_excerpt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS execution_index FROM conversations WHERE role = 'assistant'")
def transcript_executions(spark, d):
    _, u, r = transcripts.read_transcripts(spark, _transcripts(spark, d))
    return executions.extract_executions(u, r).select("session", "command", "status", "output_excerpt", F.col("execution_index").cast("long").alias("execution_index"))


# --- log


@query(f"SELECT id::VARCHAR AS external_id, session, project, chunk_index::INT AS chunk_index, sha256(content) AS hash, created_at FROM {C}")
def log_round_trip(spark, d):
    """Chunks appended to the log by month and host, and read again."""
    where = scratch(spark, "log")
    c = chunks(spark, d).withColumn("external_id", F.col("id").cast("string")).withColumn("role", F.lit("human")).withColumn("token_count", F.lit(1))
    logs.append_chunks(c, where, "host1")
    return logs.read_chunks(spark, where).select("external_id", "session", "project", "chunk_index", F.sha2("content", 256).alias("hash"), F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("SELECT user_id AS session, event_type AS kind, count(*) AS n, sum(strlen('{\"v\":' || event_id))::BIGINT AS bytes FROM events WHERE event_type = 'error' GROUP BY ALL UNION ALL SELECT user_id, event_type, count(*), sum(strlen(CASE event_type WHEN 'view' THEN '[' || event_id || ']' WHEN 'click' THEN '{\"v\":9,\"type\":\"' || event_id || '\"}' ELSE '{\"v\":1,\"type\":\"chunk\",\"id\":\"' || event_id || '\"}' END))::BIGINT FROM events WHERE event_type <> 'error' GROUP BY ALL")
def line_diagnostics(spark, d):
    """Lines of four kinds, told apart by their diagnostics: cut JSON, an array, an unknown record, and a good one."""
    n = F.col("event_id").cast("string")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit('{"v":'), n)).when(F.col("event_type") == "view", F.concat(F.lit("["), n, F.lit("]"))).when(F.col("event_type") == "click", F.concat(F.lit('{"v":9,"type":"'), n, F.lit('"}'))).otherwise(F.concat(F.lit('{"v":1,"type":"chunk","id":"'), n, F.lit('"}')))
    e = table(spark, d, "events")
    where = written(e.select("user_id", "event_id", text.alias("value")), "user_id", "event_id", name="lines")
    found = lines.parsed(lines.read_lines(spark, where), V1_CHUNK)
    id_ = F.regexp_extract("line", r"(\d+)\D*$", 1).cast("long")
    back = found.select(id_.alias("event_id"), "problem", F.octet_length("line").alias("size")).join(e, "event_id")
    said = F.when(F.col("problem") == "invalid JSON", "error").when(F.col("problem") == "record is not an object", "view").when(F.col("problem") == "unknown record version/type", "click").otherwise(F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type")))
    return back.groupBy(F.col("user_id").alias("session"), said.alias("kind")).agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"))


_TURN_LINE = "'{\"v\":2,\"type\":\"turn_checkpoint\",\"txId\":\"' || o_custkey || '\",\"sessionId\":\"' || o_custkey || '\",\"turnKey\":\"' || o_orderkey || '\"}'"


def _frame_lines(spark, d) -> DataFrame:
    """A transaction a customer, with a record an order."""
    o = table(spark, d, "orders")
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    line = F.concat(F.lit('{"v":2,"type":"turn_checkpoint","txId":"'), c, F.lit('","sessionId":"'), c, F.lit('","turnKey":"'), k, F.lit('"}'))
    return o.select(c.alias("tx_id"), F.lit("2026").alias("created_at"), F.col("o_orderkey").alias("no"), line.alias("line"))


@query(f"SELECT o_custkey::VARCHAR AS tx_id, count(*)::INT AS records, sha256(string_agg({_TURN_LINE}, chr(10) ORDER BY o_orderkey) || chr(10)) AS digest FROM orders GROUP BY o_custkey")
def frame_scan(spark, d):
    """Transactions written as frames, and read, checked and told apart again."""
    where = written(log.serialize_frame(_frame_lines(spark, d)).select("tx_id", F.array_join("lines", "\n").alias("value")), "tx_id", name="frames")
    return logs.read_frames(spark, where)[0].select("tx_id", F.size("payloads").alias("records"), "digest")


# Frames of customers of one segment have a record less than their end says.
@query("SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'invalid transaction frame' ELSE 'committed' END AS message, count(DISTINCT o_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def frame_diagnostics(spark, d):
    bad = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("tx_id"), F.lit(True).alias("bad"))
    f = log.serialize_frame(_frame_lines(spark, d)).join(bad, "tx_id", "left")
    lines_ = F.when(F.coalesce("bad", F.lit(False)), F.concat(F.slice("lines", 1, 1), F.slice("lines", F.lit(3), F.size("lines")))).otherwise(F.col("lines"))
    where = written(f.select("tx_id", F.array_join(lines_, "\n").alias("value")), "tx_id", name="frames")
    good, problems = logs.read_frames(spark, where)
    return good.select(F.lit("committed").alias("message")).unionByName(problems.select("message")).groupBy("message").agg(F.count("*").alias("n"))


# --- hooks, prompts


@query("SELECT conv_id::VARCHAR AS session, prompt FROM (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || 'more' END AS prompt FROM conversations)")
def hook_payloads(spark, d):
    """Payloads whose prompt is a text, or an array of parts of which one is no text."""
    m = table(spark, d, "conversations")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    many = F.to_json(F.struct(F.col("conv_id").cast("string").alias("session_id"), F.array(part("text", F.col("text")), part("image", F.lit("x")), part("text", F.lit("more"))).alias("prompt")))
    one = F.to_json(F.struct(F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("prompt")))
    return hooks.parse_payloads(m.select(F.when(F.col("turn") % 2 == 0, one).otherwise(many).alias("value"))).select(F.col("session_id").alias("session"), "prompt")


# Every user message begins a step.
@query(f"WITH s AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session ORDER BY line ROWS UNBOUNDED PRECEDING) AS step FROM {M}) SELECT session, trim(string_agg(text, '' ORDER BY line)) AS text FROM s WHERE role = 'assistant' AND step = (SELECT max(step) FROM s i WHERE i.session = s.session) GROUP BY session")
def wire_log(spark, d):
    m = messages(spark, d).where("role IN ('user', 'assistant')")
    event = F.when(F.col("role") == "user", F.to_json(F.struct(F.lit("context.append_loop_event").alias("type"), F.struct(F.lit("step.begin").alias("type")).alias("event")))).otherwise(F.to_json(F.struct(F.lit("context.append_loop_event").alias("type"), F.struct(F.lit("content.part").alias("type"), F.struct(F.lit("text").alias("type"), "text").alias("part")).alias("event"))))
    return hooks.wire_texts(m.select(F.col("session").alias("file"), F.col("line").alias("line_no"), event.alias("line"))).select(F.col("file").alias("session"), "text")


def _prompts(spark, d) -> DataFrame:
    u = messages(spark, d).where("role = 'user'")
    s, n = F.col("session").cast("string"), F.col("line").cast("string")
    return u.select(F.lit("codex").alias("runtime"), s.alias("session"), F.when(F.col("line") % 4 == 0, n).alias("turn_id"), F.lit("/p").alias("project"), F.col("text").alias("prompt"), F.lit(None).cast("string").alias("model"), F.concat(F.lit("k"), n).alias("pending_key"), F.col("line").cast("int").alias("turn_sequence"), F.lpad(n, 20, "0").alias("source_order"), F.lit("t").alias("created_at"))


@query("SELECT sha256('codex' || chr(0) || conv_id || chr(0) || 'k' || turn) || '.json' AS name, 'k' || turn AS pending_key, text AS prompt FROM conversations WHERE role = 'user'")
def pending_records(spark, d):
    """Waiting prompts as the files that hold them."""
    r = pending.pending_records(_prompts(spark, d))
    return r.select("name", F.get_json_object("value", "$.pendingKey").alias("pending_key"), F.get_json_object("value", "$.prompt").alias("prompt"))


# An answer takes the prompt of its turn id, the line before it, where that prompt has one; else the session's last prompt.
@query("""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND trim(text, ' ') <> ''),
l AS (SELECT conv_id, max(turn) AS turn FROM u GROUP BY conv_id)
SELECT a.conv_id::VARCHAR AS session, coalesce(o.text, p.text) AS prompt, trim(a.text) AS assistant, sha256('5:codex' || strlen(a.conv_id::VARCHAR) || ':' || a.conv_id || strlen('turn_id:' || (a.turn - 1)) || ':turn_id:' || (a.turn - 1)) AS turn_key
FROM a JOIN l USING (conv_id) JOIN u p ON p.conv_id = l.conv_id AND p.turn = l.turn LEFT JOIN u o ON o.conv_id = a.conv_id AND o.turn = a.turn - 1 AND o.turn % 4 = 0""")
def paired_answers(spark, d):
    a = messages(spark, d).where("role = 'assistant'")
    stops = a.select(F.lit("codex").alias("runtime"), F.col("session").cast("string").alias("session"), (F.col("line") - 1).cast("string").alias("turn_id"), F.lit("/p").alias("project"), F.col("text").alias("answer"), F.col("line").alias("sequence"), F.lit("t").alias("completed_at"), F.lit(None).cast("string").alias("model"))
    return pending.pair_answers(_prompts(spark, d), stops).select("session", "prompt", "assistant", "turn_key")


# --- text and identity


@query("SELECT conv_id AS session, turn AS line, sha256('1:r' || strlen(conv_id::VARCHAR) || ':' || conv_id || strlen(text) || ':' || text) AS turn_key, 'r-' || sha256(strlen(conv_id::VARCHAR) || ':' || conv_id || strlen(text) || ':' || text || strlen(turn::VARCHAR) || ':' || turn) AS part FROM conversations")
def turn_keys(spark, d):
    s = F.col("session").cast("string")
    return messages(spark, d).select("session", "line", T.turn_key(F.lit("r"), s, F.col("text")).alias("turn_key"), T.part_id(F.lit("r"), s, F.col("text"), F.col("line")).alias("part"))


@query("""WITH h AS (SELECT o_custkey, sha256(strlen(o_orderkey::VARCHAR) || ':' || o_orderkey || '1:1' || strlen(o_orderstatus) || ':' || o_orderstatus) AS h FROM orders)
SELECT o_custkey AS session, sha256(strlen(o_custkey::VARCHAR) || ':' || o_custkey || '1:0' || string_agg('64:' || h, '' ORDER BY h)) AS tx_id FROM h GROUP BY o_custkey""")
def transaction_ids(spark, d):
    """Identity of a transaction of many turns, whatever their order."""
    h = T.hash_fields(F.col("o_orderkey"), F.lit(1), F.col("o_orderstatus"))
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("session")).agg(F.collect_list(h).alias("hs"))
    return g.select("session", T.transaction_id(F.col("session").cast("string"), F.lit(0), F.lit(False), F.col("hs")).alias("tx_id"))


@query("SELECT conv_id AS session, turn AS line, sha256('1:r2:/p' || strlen(text) || ':' || text || '1:a1:13:out1:1' || strlen(text) || ':' || text || strlen(role) || ':' || role || strlen(ceil(length(text) / 4.0)::BIGINT::VARCHAR) || ':' || ceil(length(text) / 4.0)::BIGINT || '1:11:02:sh2:ls6:failed4:null0:') AS hash FROM conversations")
def turn_content_hash(spark, d):
    """The hash of a turn with a tool result, a part and an execution without exit code."""
    part = F.struct(F.col("text").alias("content"), "role", T.estimate_tokens(F.col("text")).alias("tokenCount"))
    run = F.struct(F.lit(0).alias("executionIndex"), F.lit("sh").alias("toolName"), F.lit("ls").alias("command"), F.lit("failed").alias("status"), F.lit(None).cast("int").alias("exitCode"), F.lit("").alias("outputExcerpt"))
    h = T.content_hash(F.lit("r"), F.lit("/p"), F.col("text"), F.lit("a"), F.array(F.lit("out")), F.array(part), F.array(run))
    return messages(spark, d).select("session", "line", h.alias("hash"))


# 65,536 bytes less those of the marker, four fifths from the start; texts are ASCII.
@query("WITH t AS (SELECT s_suppkey AS id, repeat(s_name || ' ', 3000 + (s_suppkey * 50)::INT) AS x FROM supplier), m AS (SELECT chr(10) || '...(truncated by byte limit)...' || chr(10) AS m) SELECT id, sha256(CASE WHEN length(x) <= 65536 THEN x ELSE left(x, floor((65536 - length(m)) * 0.8)::INT) || m || right(x, (65536 - length(m) - floor((65536 - length(m)) * 0.8))::INT) END) AS hash FROM t, m")
def byte_truncation(spark, d):
    # A small file is one task, but its rows become long texts.
    s = duplicates.spread(table(spark, d, "supplier").select("s_suppkey", "s_name")).select(F.col("s_suppkey").alias("id"), F.repeat(F.concat("s_name", F.lit(" ")), F.lit(3000) + F.col("s_suppkey").cast("int") * 50).alias("x"))
    return s.select("id", F.sha2(T.truncate_output(F.col("x")), 256).alias("hash"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN [o_orderpriority, 'b'] WHEN o_orderstatus = 'O' THEN ['a', o_orderpriority] ELSE [] END AS files FROM orders")
def file_lists(spark, d):
    """Lists as JSON arrays, with commas, and blank."""
    p = F.col("o_orderpriority")
    text = F.when(F.col("o_orderstatus") == "F", F.to_json(F.array(p, F.lit(" "), F.lit("b")))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("a, "), p, F.lit(",, "))).otherwise(" ")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.file_list(text).alias("files"))


@query("SELECT o_orderkey AS id, sha256('[claude-mem observation: ' || o_orderstatus || ']' || chr(10) || o_orderpriority || chr(10) || '' || chr(10) || 'told' || CASE WHEN o_orderstatus = 'F' THEN chr(10) || chr(10) || 'facts' ELSE '' END) AS observation, sha256('[claude-mem summary]' || chr(10) || 'Request: ' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN chr(10) || 'Learned: much' ELSE '' END || chr(10) || 'Next steps: go') AS summary FROM orders")
def imported_texts(spark, d):
    done = F.col("o_orderstatus") == "F"
    seen = T.observation_text(F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("told"), F.when(done, "facts").otherwise(""))
    told = T.summary_text(request=F.col("o_orderpriority"), investigated=F.lit(""), learned=F.when(done, "much").otherwise(""), completed=F.lit(None).cast("string"), next_steps=F.lit("go"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(seen, 256).alias("observation"), F.sha2(told, 256).alias("summary"))


@query("SELECT vec_id AS id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 4) + 0.0::DOUBLE) AS v FROM embeddings")
def unit_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(embedding.unit(F.col("embedding")), lambda x: F.round(x, 4) + 0.0).alias("v"))


@query("SELECT label, round(sum(list_sum(embedding)) / count(*), 5) AS total FROM embeddings GROUP BY label")
def pooled_vectors(spark, d):
    """The mean of the vectors of a label, summed."""
    g = table(spark, d, "embeddings").groupBy("label").agg(F.collect_list("embedding").alias("tokens"))
    return g.select("label", F.round(F.aggregate(embedding.mean_pooled(F.col("tokens")), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT doc_id AS id, sha256('検索文書: ' || left(text, 512)) AS hash FROM documents")
def embedding_inputs(spark, d):
    return chunks(spark, d).select("id", F.sha2(embedding.document_input(F.col("content")), 256).alias("hash"))


@query("SELECT vec_id AS id, round(list_sum(CASE WHEN label = 1 THEN [0.0::DOUBLE, 1.0] ELSE embedding END), 4) AS total FROM embeddings")
def insert_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    new = v.where("label = 1").select("id", F.array(F.lit(0.0), F.lit(1.0)).alias("embedding"))
    return embedding.insert_vectors(v.drop("label"), new).select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


# --- the engine


#: Bits of the bitmap of ids that have a vector: 8 MB, in at most 2048 rows.
BITS = 1 << 26


def with_vectors(c: DataFrame, v: DataFrame) -> DataFrame:
    """c with the vectors of v (id, v), null where there is none. Only rows that may have one are shuffled with their texts: a bitmap of the ids' hashes tells which."""
    place = F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(BITS))
    at = F.bitmap_bit_position(place)
    bits = v.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.expr("shiftright(_byte, _bit) % 2 = 1"), F.lit(False))
    d = c.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_bucket", "left").withColumn("_byte", byte).withColumn("_bit", (at % 8).cast("int")).withColumn("_may", may)
    own = d.where("_may").select(*c.columns).join(v, "id", "left")
    return own.unionByName(d.where("NOT _may").select(*c.columns, F.lit(None).cast(v.schema["v"].dataType).alias("v")))


def written_log(spark, d) -> str:
    """Documents as version 1 records, those with a vector with it, and orders as committed turns of customers, in compressed files."""
    where = scratch(spark, "log")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("float")).alias("v"))
    c = with_vectors(chunks(spark, d), v)
    one = F.struct(F.lit(1).alias("v"), F.lit("chunk").alias("type"), F.col("id").cast("string").alias("id"), F.col("session").alias("sessionId"), F.col("project").alias("projectPath"), F.col("chunk_index").alias("chunkIndex"), "content", F.lit("human").alias("role"), F.lit(1).alias("tokenCount"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("createdAt"), T.vec_to_hex("v").alias("embedding"))
    c.select(F.to_json(one).alias("value")).write.option("compression", "gzip").text(f"{where}/v1")
    # A customer's orders come together before they are lines, which are thirty times as large.
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string").alias("tx_id"))
    o = o.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-o.count() // 50_000)), "tx_id")
    key, session = F.col("o_orderkey").cast("string"), F.col("tx_id")
    meta = F.struct(F.array().cast("array<string>").alias("filePaths"), F.array().cast("array<string>").alias("toolNames"), F.array().cast("array<string>").alias("errorMessages"))
    part = F.struct(F.lit(0).alias("partIndex"), F.concat(F.lit("o-"), key).alias("externalId"), F.col("o_orderpriority").alias("content"), F.lit("human").alias("role"), meta.alias("metadata"), F.lit(2).alias("tokenCount"))
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "succeeded").otherwise("unknown")
    run = F.struct(F.lit(0).alias("executionIndex"), F.lit("sh").alias("toolName"), F.lit("make").alias("command"), status.alias("status"), F.lit("out").alias("outputExcerpt"))
    at = F.struct(F.lit("source_offset").alias("kind"), F.lit(0).alias("generation"), F.col("o_orderkey").alias("offset"))
    turn = F.to_json(F.struct(F.lit(2).alias("v"), F.lit("turn_checkpoint").alias("type"), session.alias("txId"), session.alias("sessionId"), F.lit("claude").alias("runtime"), key.alias("turnKey"), F.lpad(key, 20, "0").alias("sourceOrder"), F.lit(0).alias("historyEpoch"), F.lit(1).alias("revision"), F.sha2(key, 256).alias("contentHash"), F.lit("2026-01-01T00:00:00Z").alias("completedAt"), F.lit("/p").alias("projectPath"), at.alias("observedThrough"), F.array(part).alias("parts"), F.array(run).alias("executions")))
    frames = log.serialize_frame(o.select("tx_id", F.lit("2026").alias("created_at"), F.col("o_orderkey").alias("no"), turn.alias("line")))
    frames.select(F.array_join("lines", "\n").alias("value")).write.option("compression", "gzip").text(f"{where}/v2")
    return where


@query(f"""WITH r AS (SELECT o_custkey AS session, coalesce(sum((o_orderstatus = 'O')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'O')),
g AS (SELECT session, island FROM r GROUP BY ALL HAVING count(*) FILTER (s = 'F') > 0 AND count(*) FILTER (s = 'O') = 1)
SELECT 'chunks' AS name, (SELECT count(*) FROM documents) + (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'sessions', (SELECT count(DISTINCT session) FROM {C}) + (SELECT count(DISTINCT o_custkey) FROM orders) UNION ALL SELECT 'observations', count(*) FROM orders
UNION ALL SELECT 'resolutions', count(*) FROM g UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) UNION ALL SELECT 'heads', count(*) FROM orders UNION ALL SELECT 'committed', count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'characters', (SELECT sum(length(text)) FROM documents) + (SELECT sum(length(o_orderpriority)) FROM orders)""")
def rebuild_tables(spark, d):
    """A log of records and transactions folded to all tables, by their sizes."""
    e = MemoryEngine(spark, scratch(spark, "store"))
    e.rebuild(written_log(spark, d))
    count = lambda name: e.table(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    out = e.chunks().agg(F.sum(F.length("content")).alias("n")).select(F.lit("characters").alias("name"), "n")
    for name in ("chunks", "sessions", "observations", "resolutions", "vectors", "heads", "committed"):
        out = out.unionByName(count(name))
    return out


@query("SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM orders) AS chunks")
def insert_count(spark, d):
    where = written_log(spark, d)
    turns, _ = logs.payloads(logs.read_frames(spark, where)[0])
    return log.insert_count(logs.read_chunks(spark, where), turns)


def _candidates(spark, d) -> DataFrame:
    """Turns of the conversations as candidates."""
    from .operators import sessions

    t = sessions.turns(messages(spark, d))
    s, n = F.col("session").cast("string"), F.col("turn_no").cast("string")
    at = F.struct(F.lit("source_offset").alias("kind"), F.lit(0).cast("long").alias("generation"), F.col("line").cast("long").alias("offset"), F.lit(None).cast("long").alias("sequence"))
    return t.select(F.lit("claude").alias("runtime"), s.alias("session"), F.lit("/p").alias("project"), T.turn_key(F.lit("claude"), s, n).alias("turn_key"), F.lpad(n, 20, "0").alias("source_order"), at.alias("observed_through"), F.lit("2026-01-01T00:00:00Z").alias("completed_at"), F.col("human").alias("prompt"), F.col("assistant").alias("assistant"), F.array().cast("array<string>").alias("tool_results"), F.array().cast(f"array<{EXECUTION.simpleString()}>").alias("executions"), F.concat(F.lit("k"), n).alias("pending_key"), F.lit(None).cast("string").alias("model"))


# All turns are new; then those of odd number are the same again, and the others come with another answer and a later place.
@query(f"SELECT session::VARCHAR AS session, sha256('6:claude' || strlen(session::VARCHAR) || ':' || session || strlen(turn_no::VARCHAR) || ':' || turn_no) AS turn_key, CASE WHEN turn_no % 2 = 1 THEN 1 ELSE 2 END AS revision, CASE WHEN turn_no % 2 = 1 THEN 'already_current' ELSE 'inserted' END AS status FROM {_TURNS}")
def commit_checkpoints(spark, d):
    e, where = MemoryEngine(spark, scratch(spark, "store")), scratch(spark, "log")
    c = _candidates(spark, d)
    e.commit(c, where, NOW)
    even = F.pmod(F.regexp_extract("pending_key", r"\d+", 0).cast("int"), F.lit(2)) == 0
    at = F.struct(F.col("observed_through.kind").alias("kind"), F.col("observed_through.generation").alias("generation"), (F.col("observed_through.offset") + 1).alias("offset"), F.col("observed_through.sequence").alias("sequence"))
    again = c.withColumn("assistant", F.when(even, F.concat("assistant", F.lit(" more"))).otherwise(F.col("assistant"))).withColumn("observed_through", F.when(even, at).otherwise(F.col("observed_through")))
    return e.commit(again, where, NOW)


# After a reset of every session, the first turn of each comes again in epoch 1; its other chunks are gone.
@query(f"SELECT session::VARCHAR AS session, 1 AS history_epoch, 1::BIGINT AS turns FROM {_TURNS} GROUP BY session")
def baseline_replace(spark, d):
    e, where = MemoryEngine(spark, scratch(spark, "store")), scratch(spark, "log")
    c = _candidates(spark, d)
    e.commit(c, where, NOW)
    first = c.groupBy("session").agg(F.min("source_order").alias("source_order"))
    e.commit(c.join(first, ["session", "source_order"], "left_semi"), where, NOW, resets=c.select("session", F.lit("legacy_mismatch").alias("reason")).distinct())
    return e.chunks().groupBy("session").agg(F.max("history_epoch").alias("history_epoch"), F.count_distinct("turn_key").alias("turns"))


@query("SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(DISTINCT source || lang) FROM documents) AS stored_sessions, count(*) FILTER (event_type IN ('error', 'purchase')) AS explicit_observations, count(*) FILTER (event_type NOT IN ('error', 'purchase')) AS unknown_observations, (SELECT count(*) FROM (" + _RES + ")) AS resolutions FROM events")
def overview(spark, d):
    from .operators import sessions

    c, o = chunks(spark, d), observations(spark, d)
    return store.overview(c, sessions.session_summary(c), o, executions.resolutions(o)).select("chunks", "stored_sessions", "explicit_observations", "unknown_observations", "resolutions")


@query("SELECT o_custkey AS session, o_orderpriority AS turn_key, max(o_orderkey % 50)::INT AS revision FROM orders GROUP BY ALL")
def advanced_heads(spark, d):
    """Heads of even revisions advanced by all revisions of a turn, in order of their boundary."""
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderpriority").alias("turn_key"), F.lit(0).alias("history_epoch"), (F.col("o_orderkey") % 50).cast("int").alias("revision"))
    at = F.struct(F.lit("source_offset").alias("kind"), F.lit(0).cast("long").alias("generation"), F.col("revision").cast("long").alias("offset"), F.lit(None).cast("long").alias("sequence"))
    r = r.withColumn("content_hash", F.col("revision").cast("string")).withColumn("source_order", F.lit("0")).withColumn("observed_through", at).distinct()
    heads = log.latest_revisions(r.where("revision % 2 = 0"))
    return checkpoints.advance(heads, r)[0].select("session", "turn_key", "revision")


# --- streams


def _streamed(spark: SparkSession, rows: DataFrame, make, name: str, by: Column) -> DataFrame:
    """rows through make as a stream that stops and goes on: four micro-batches or more, each with the rows of a quarter of `by`. -> what it wrote."""
    where = scratch(spark, name)
    # Stored once, as each quarter would make the rows anew.
    rows.withColumn("_by", by.cast("double")).write.parquet(f"{where}/rows")
    d = spark.read.parquet(f"{where}/rows")
    edges = [float("-inf"), *d.approxQuantile("_by", [0.25, 0.5, 0.75], 0.001), float("inf")]
    for low, high in zip(edges, edges[1:], strict=False):
        d.where((F.col("_by") > low) & (F.col("_by") <= high)).drop("_by").write.mode("append").parquet(f"{where}/in")
        made = make(spark.readStream.schema(rows.schema).parquet(f"{where}/in"))
        made.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{where}/out")


@query(f"SELECT session, first_failure_turn, last_failure_turn, failure_count, success_turn FROM {_RES}")
def stream_resolutions(spark, d):
    """resolutions, with pending failures in state, from four micro-batches."""
    o = observations(spark, d).select("runtime", "project", F.col("session").cast("string").alias("session"), "command", "history_epoch", "source_order", "execution_index", "turn_key", "status", "output_excerpt")
    found = _streamed(spark, o, streams.resolutions, "resolutions", F.col("source_order"))
    return found.select(F.col("session").cast("long").alias("session"), "first_failure_turn", "last_failure_turn", "failure_count", "success_turn")


@query("SELECT user_id::VARCHAR AS session, event_type AS pending_key, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS sequence FROM events")
def stream_sequences(spark, d):
    """Numbers of a session's keys, which a key keeps where it comes again; keys arrive in order of their first letter."""
    e = table(spark, d, "events").select(F.lit("r").alias("runtime"), F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("pending_key"))
    return _streamed(spark, e, streams.sequences, "sequences", F.ascii("pending_key")).select("session", "pending_key", "sequence")


@query(f"SELECT session::VARCHAR AS session, status, count(*) AS n FROM (SELECT session, CASE WHEN row_number() OVER (PARTITION BY session, turn_key ORDER BY o_orderkey) = 1 OR revision > max(revision) OVER (PARTITION BY session, turn_key ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'inserted' WHEN revision < max(revision) OVER (PARTITION BY session, turn_key ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'stale' ELSE 'conflict' END AS status FROM (SELECT o_custkey AS session, o_orderpriority AS turn_key, o_orderkey % 7 AS revision, o_orderkey FROM orders)) GROUP BY ALL")
def stream_decisions(spark, d):
    """Revisions of turns in order of their place, each with other content: newer ones are inserted, older ones stale, and equal ones conflicts."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("session"), F.col("o_orderpriority").alias("turn_key"), F.lit(0).alias("history_epoch"), (F.col("o_orderkey") % 7).cast("int").alias("revision"), F.col("o_orderkey").cast("string").alias("content_hash"), F.lit(0).cast("long").alias("generation"), F.col("o_orderkey").alias("offset"))
    found = _streamed(spark, o, streams.decide, "decisions", F.col("offset"))
    return found.groupBy("session", "status").agg(F.count("*").alias("n"))


# A reset starts the epoch after its order's number; the orders up to the next one are turns of that epoch.
@query("""WITH o AS (SELECT o_custkey AS session, o_orderpriority AS turn_key, o_orderkey AS k, (o_orderkey % 7)::INT AS revision, o_orderstatus, coalesce(max(o_orderkey + 1) FILTER (o_orderstatus = 'P') OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS epoch FROM orders),
t AS (SELECT *, row_number() OVER w AS nth, max(revision) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o WHERE o_orderstatus <> 'P' WINDOW w AS (PARTITION BY session, turn_key, epoch ORDER BY k))
SELECT session::VARCHAR AS session, status, count(*) AS n FROM (SELECT session, 'reset' AS status FROM o WHERE o_orderstatus = 'P' UNION ALL
SELECT session, CASE WHEN nth = 1 OR revision > top THEN 'inserted' WHEN revision < top THEN 'stale' ELSE 'conflict' END FROM t) GROUP BY ALL""")
def stream_resets(spark, d):
    """Turns and resets of a stream; the heads of a session's turns are forgotten at each reset."""
    o = table(spark, d, "orders")
    reset = F.col("o_orderstatus") == "P"
    epoch = F.coalesce(F.max(F.when(reset, F.col("o_orderkey") + 1)).over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = o.select(
        F.col("o_custkey").cast("string").alias("session"), F.when(reset, "reset").otherwise("turn").alias("kind"), F.col("o_orderpriority").alias("turn_key"), epoch.cast("int").alias("history_epoch"), (F.col("o_orderkey") % 7).cast("int").alias("revision"),
        F.col("o_orderkey").cast("string").alias("content_hash"), F.lit(0).cast("long").alias("generation"), F.col("o_orderkey").alias("offset"))
    return _streamed(spark, rows, streams.decide_with_resets, "resets", F.col("offset")).groupBy("session", "status").agg(F.count("*").alias("n"))


# A prompt waits until an answer takes it. With 1 for a prompt and -1 for an answer, sums that fall to a new low below 0 are answers without one.
@query(f"""WITH x AS (SELECT session, role, sum(CASE role WHEN 'user' THEN 1 ELSE -1 END) OVER (PARTITION BY session ORDER BY line ROWS UNBOUNDED PRECEDING) AS w FROM {M})
SELECT session::VARCHAR AS session, count(*) FILTER (role = 'assistant') AS answers, (count(*) FILTER (role = 'assistant') + least(0, min(w)))::BIGINT AS ready FROM x GROUP BY session HAVING count(*) FILTER (role = 'assistant') > 0""")
def stream_pairs(spark, d):
    """Answers of a stream, and how many found a prompt, whose text they then have."""
    m = messages(spark, d).where("role IN ('user', 'assistant')")
    n = F.col("line").cast("string")
    rows = m.select(F.lit("r").alias("runtime"), F.col("session").cast("string").alias("session"), F.col("line").alias("at"), F.when(F.col("role") == "user", "prompt").otherwise("stop").alias("kind"), F.lit(None).cast("string").alias("turn_id"), F.concat(F.lit("k"), n).alias("pending_key"), F.lpad(n, 20, "0").alias("source_order"), "text")
    found = _streamed(spark, rows, streams.pair_answers, "pairs", F.col("at"))
    after = m.select(F.col("session").cast("string").alias("session"), F.col("line"), "role", F.col("text").alias("prompt"))
    both = after.where("role = 'user'").select("session", F.concat(F.lit("k"), F.col("line").cast("string")).alias("pending_key"), F.col("prompt").alias("own"))
    d2 = found.join(both, ["session", "pending_key"], "left")
    return d2.groupBy("session").agg(F.count("*").alias("answers"), F.count_if((F.col("status") == "ready") & (F.col("prompt") == F.col("own"))).alias("ready"))


@query("SELECT user_id, max(ts) AS last, count(*) AS events FROM (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS step FROM events)) GROUP BY user_id, s")
def event_sessions(spark, d):
    """Event-time sessions; the same operator takes a stream, whose last sessions wait for the watermark."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = streams.sessions_of(e)
    return found.select("user_id", (F.col("end") - F.expr("INTERVAL 30 MINUTES")).cast("timestamp_ntz").alias("last"), "events")


