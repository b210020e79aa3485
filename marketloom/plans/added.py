"""Queries of sources and sinks, vocabularies, trajectories, option means, chat formats, fused baselines, and edges of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, indicators, metrics, models, preference, trajectory
from ..sources import io, requests
from ..sources.shared import new_folder, saved
from . import fixtures as X
from .more import CONV, VOCAB, _turns
from .queries import PRED, _labelled, query, r

# ---- sources and sinks: what comes back after a round trip


@query("""SELECT o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total, min(o_orderkey) first_key FROM orders GROUP BY 1""")
def table_round_trip(s: SparkSession, d: str) -> DataFrame:
    at = new_folder(s, "table")
    io.write_table(X.read(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), at, ("o_orderpriority",))
    return io.read_table(s, at).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("first_key"))


@query("""SELECT conv_id, turn, md5(coalesce("text", '')) text_md5, "role" IS NULL no_role FROM conversations""")
def jsonl_round_trip(s: SparkSession, d: str) -> DataFrame:
    at = new_folder(s, "jsonl")
    io.write_jsonl(X.read(s, d, "conversations").select("conv_id", "turn", "role", "text"), at)
    x = io.read_jsonl(s, at, "conv_id long, turn long, role string, text string")
    return x.select("conv_id", F.col("turn").cast(X.read(s, d, "conversations").schema["turn"].dataType).alias("turn"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.col("role").isNull().alias("no_role"))


@query("""SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) acctbal FROM customer""")
def tsv_round_trip(s: SparkSession, d: str) -> DataFrame:
    at = new_folder(s, "tsv")
    c = X.read(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    io.write_csv(c, at, "\t")
    return io.read_csv(s, at, c.schema.simpleString()[7:-1].replace(":", " "), "\t").select("c_custkey", "c_mktsegment", r("c_acctbal", 2).alias("acctbal"))


@query("""SELECT 'T' || conv_id % 4 ticker, DATE '2020-01-01' + CAST(conv_id % 3 AS INT) date, conv_id, turn FROM conversations""")
def dated_folders(s: SparkSession, d: str) -> DataFrame:
    """A folder for each ticker and a file for each day, as a crawler leaves them; ticker and day come back from the paths."""
    at, c = new_folder(s, "dated"), X.read(s, d, "conversations").select("conv_id", "turn")
    for k in range(12):
        c.where((F.col("conv_id") % 4 == k % 4) & (F.col("conv_id") % 3 == k % 3)).coalesce(1).write.json(f"{at}/T{k % 4}/2020-01-{k % 3 + 1:02}")
    x = io.scan_dated_dirs(s, at, "conv_id long, turn long")
    return x.select("ticker", "date", "conv_id", F.col("turn").cast(c.schema["turn"].dataType).alias("turn"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100""")
def first_rows(s: SparkSession, d: str) -> DataFrame:
    x = X.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return io.head_preview(x.withColumn("k", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), 100, "k").drop("k")


@query("""SELECT CASE WHEN vec_id % 50 = 0 THEN 'UNK' ELSE 'w' || vec_id END word, CAST(len(embedding) AS INT) width, round(CAST(embedding[1] AS DOUBLE), 4) first_number FROM embeddings WHERE vec_id % 50 = 0 OR vec_id % 2 = 1""")
def word_vectors(s: SparkSession, d: str) -> DataFrame:
    """A file of "word f1 f2 ..." with several spellings of unknown; only the vocabulary's words come back."""
    at, e = new_folder(s, "vectors"), X.read(s, d, "embeddings")
    i = F.col("vec_id")
    word = F.when(i % 100 == 0, "<unk>").when(i % 50 == 0, "unk").otherwise(F.concat(F.lit("w"), i.cast("string")))
    e.select(F.concat_ws(" ", word, F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ")).alias("value")).write.text(at)
    vocab = e.where(i % 2 == 1).select(F.concat(F.lit("w"), i.cast("string")).alias("word")).unionByName(s.sql("SELECT 'UNK' word"))
    return io.load_word_vectors(s, at, vocab).select("word", F.size("vector").alias("width"), r(F.col("vector")[0]).alias("first_number"))


# Of the customers, every seventh has a result, every eleventh an empty one. The second run asks for what a first one on the
# even keys has left; a third run on the same rows has nothing to do.
@query("""WITH todo AS (SELECT c_custkey k, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0), one AS (SELECT k, c_mktsegment, (row_number() OVER (ORDER BY k) - 1) // 100 + 1 part FROM todo WHERE k % 2 = 0),
 two AS (SELECT k, c_mktsegment, (row_number() OVER (ORDER BY k) - 1) // 100 + 1 + (SELECT max(part) FROM one) part FROM todo WHERE k % 2 = 1)
 SELECT part, count(*) n, min(k) first_key, max(k) last_key, md5(string_agg('{"custom_id":"' || k || '","method":"POST","url":"/v1/chat/completions","body":{"model":"m","messages":[{"role":"user","content":"' || c_mktsegment || '"}]}}', '\n' ORDER BY k)) lines_md5 FROM (FROM one UNION ALL FROM two) GROUP BY part""")
def request_parts(s: SparkSession, d: str) -> DataFrame:
    at, c = new_folder(s, "requests"), X.read(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("prompt"))
    cache = c.where("k % 7 = 0 OR k % 11 = 0").select("k", F.when(F.col("k") % 7 == 0, "done").otherwise("").alias("result"))
    for rows in (c.where("k % 2 = 0"), c, c):
        written = requests.write_requests(rows, cache, at, "k", "prompt", "result", "m", 100)
    assert written.count() == 0, "the third run wrote requests"
    line = requests.read_requests(s, at).withColumn("k", F.get_json_object("request", "$.custom_id").cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "request"))), lambda x: x["request"]), "\n")
    return line.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.md5(text).alias("lines_md5"))


@query("""SELECT c_custkey k, CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE 'new' END result FROM customer""")
def result_cache(s: SparkSession, d: str) -> DataFrame:
    """A cache with results of every fifth row, some of the others empty, and the results of the rows that lacked one."""
    c = X.read(s, d, "customer").select(F.col("c_custkey").alias("k"))
    cache = c.where("k % 5 = 0 OR k % 3 = 0").withColumn("result", F.when(F.col("k") % 5 == 0, "old").otherwise(""))
    return io.merge_cache(cache, io.pending(c, cache, "k", "result").withColumn("result", F.lit("new")), "k", "result")


# ---- vocabularies


@query(f"WITH {CONV}, {VOCAB} SELECT w word, id FROM vb")
def vocabulary(s: SparkSession, d: str) -> DataFrame:
    return preference.vocabulary(_turns(s, d).where("conv_id % 2 = 0").select(F.explode("w").alias("word")))


@query(f"WITH {CONV}, {VOCAB} SELECT conv_id * 100 + turn stock_id, id word_id FROM cv LEFT JOIN vb ON vb.w = lower(cv.w[1])")
def stock_words(s: SparkSession, d: str) -> DataFrame:
    t = _turns(s, d)
    vocab = preference.vocabulary(t.where("conv_id % 2 = 0").select(F.explode("w").alias("word")))
    return preference.stock_word_ids(t.select((F.col("conv_id") * 100 + F.col("turn")).alias("stock_id"), F.upper(F.get("w", F.lit(0))).alias("symbol")), vocab)


# ---- trajectories and option means

SHAPE = (trajectory.Group("allies", "{x, y; health}", 1, 4, 0, ((1, 2), (3,))), trajectory.Group("enemies", "{health}", 2, 2, 0, ((1,),)))
MOVES = ("view", "click", "cart", "purchase", "error")


def _steps(s: SparkSession, d: str) -> DataFrame:
    """A user's events in order as states and actions, for two agents each."""
    from pyspark.sql.window import Window

    e = X.read(s, d, "events").withColumn("t", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    v, i = F.col("value").cast("double"), F.col("event_id")
    agents = e.withColumn("agent", F.explode(F.array(F.lit(0), F.lit(1))))
    a = F.col("agent")
    number = lambda c: c.cast("double")
    state = F.array(number(i % 2), v, number(a), number(i % 10), number(i % 3), v, number((i + a) % 2), number(i % 7), v, v, v, v, number(i % 100))
    return agents.select(F.col("user_id").alias("trajectory"), "agent", "t", F.when(F.col("t") % 2 == 0, state).alias("state"), F.when(F.col("t") % 2 == 1, ((i + a) % 5).cast("int")).alias("action"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 t FROM events), g AS (SELECT user_id trajectory, agent, t, t // 8 chunk, value v, event_id i, (event_id + agent) % 5 act FROM e, (SELECT unnest([0, 1]) agent)),
 p AS (SELECT *, CASE WHEN t % 2 = 0 THEN '{State:{' || CASE WHEN i % 2 = 0 THEN 'None visible allies; ' ELSE 'visible allies: {x, y; health} {id 0: [' || printf('%.2f', v) || ' ' || printf('%.2f', agent::DOUBLE) || ']; ' || printf('%.2f', (i % 10)::DOUBLE) || '}; ' END ||
  CASE WHEN i % 3 = 0 AND (i + agent) % 2 = 0 THEN 'None visible enemies; ' ELSE 'visible enemies: {health} ' || CASE WHEN i % 3 <> 0 THEN '{id 0: ' || printf('%.2f', v) || '}; ' ELSE '' END || CASE WHEN (i + agent) % 2 <> 0 THEN '{id 1: ' || printf('%.2f', (i % 7)::DOUBLE) || '}; ' ELSE '' END END || 'own_health: ' || printf('%.2f', (i % 100)::DOUBLE) || '}; '
  WHEN t % 8 <> 7 THEN 'Action: ' || (['view', 'click', 'cart', 'purchase', 'error'])[act + 1] || '; } ' END piece FROM g),
 c AS (SELECT trajectory, agent, chunk, string_agg(piece, '' ORDER BY t) txt, max(CASE WHEN t % 8 = 7 THEN act END) answer FROM p GROUP BY ALL HAVING count(*) FILTER (t % 8 = 7) > 0),
 n AS (SELECT *, CAST('0x' || substr(md5(trajectory || ':' || agent || ':' || chunk || ':42'), 1, 7) AS BIGINT) % 4 draw FROM c)
 SELECT trajectory, agent, chunk, txt AS "text", CAST(answer AS INT) answer, CAST(CASE WHEN draw >= answer THEN draw + 1 ELSE draw END AS INT) negative FROM n""")
def trajectory_texts(s: SparkSession, d: str) -> DataFrame:
    return trajectory.trajectory_chunks(_steps(s, d), SHAPE, MOVES, own=4)


@query("""WITH e AS (SELECT vec_id, label % 4 truth, list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE))) f, [vec_id % 5, 3, 1 + vec_id % 7, 4] n FROM embeddings), g AS (SELECT *, list_transform(n, lambda k: k + 2) size FROM e),
 o AS (SELECT vec_id, truth, f, unnest(n) n, unnest(size) size, unnest([0, size[1], size[1] + size[2], size[1] + size[2] + size[3]]) start, unnest([0, 1, 2, 3]) k FROM g), m AS (SELECT vec_id, truth, k, CASE WHEN n > 0 THEN list_sum(f[start + 2:start + 1 + n]) / n END m FROM o),
 b AS (SELECT vec_id, truth, max(m) top, min(m) low, count(m) n_means FROM m GROUP BY ALL) SELECT b.vec_id, n_means, round(top, 6) best_mean, round(low, 6) worst_mean, (SELECT min(k) FROM m WHERE m.vec_id = b.vec_id AND m.m = top) = truth positive FROM b""")
def option_means(s: SparkSession, d: str) -> DataFrame:
    """Options of 0 to 7 tokens between one token before and one behind, cut out of one array; the best mean tells the rows apart."""
    i = F.col("vec_id").cast("int")
    lengths = F.array(i % 5, F.lit(3), 1 + i % 7, F.lit(4))
    e = X.read(s, d, "embeddings").select("vec_id", (F.col("label") % 4).alias("truth"), F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("f"), lengths.alias("n"))
    e = e.withColumn("options", trajectory.cut_spans(F.col("f"), F.transform("n", lambda k: k + 2))).withColumn("means", trajectory.span_means(F.col("options"), F.col("n"), 1))
    out = preference.split_by_argmax(e, "means", "truth")
    return out.select("vec_id", F.size(F.array_compact("means")).cast("long").alias("n_means"), r(F.array_max("means"), 6).alias("best_mean"), r(F.array_min("means"), 6).alias("worst_mean"), "positive")


# ---- texts: chats, actions, surgery, masks

_TURN = "'<|im_start|>' || \"role\" || chr(10) || body || '<|im_end|>' || chr(10)"


@query(f"""WITH {CONV}, t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) k FROM cv), m AS (SELECT conv_id, string_agg({_TURN}, '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) chat, coalesce(string_agg({_TURN}, '' ORDER BY turn) FILTER (k > 1), '') prompt, string_agg({_TURN}, '' ORDER BY turn) FILTER (k = 1) answer FROM t GROUP BY conv_id)
 SELECT conv_id, md5(chat) chat_md5, md5(prompt) prompt_md5, md5(answer) completion_md5 FROM m""")
def chat_texts(s: SparkSession, d: str) -> DataFrame:
    """Whole conversations with an open answer, and their last turn as what goes beyond the prompt."""
    m = X.messages(s, d)
    chat = lambda x, opening=None: T.chat_template(x, T.CHATML, T.CHATML_END, opening)
    prompt = chat(F.slice(F.col("messages"), F.lit(1), F.size("messages") - 1))
    return m.select("conv_id", F.md5(chat(F.col("messages"), T.CHATML_OPENING)).alias("chat_md5"), F.md5(prompt).alias("prompt_md5"), F.md5(T.completion_of(chat(F.col("messages")), prompt)).alias("completion_md5"))


@query("""SELECT event_id, CASE lower(trim(a)) WHEN 'buy' THEN 'long' WHEN 'sell' THEN 'short' WHEN 'long' THEN 'long' WHEN 'short' THEN 'short' ELSE 'hold' END action FROM (SELECT event_id, (['BUY', ' Sell ', 'long', 'Short', 'Hold', 'wait', event_type])[event_id % 7 + 1] a FROM events)""")
def action_aliases(s: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("BUY", " Sell ", "long", "Short", "Hold", "wait")), F.col("event_type")), (F.col("event_id") % 7 + 1).cast("int"))
    return X.read(s, d, "events").select("event_id", T.normalize_action(said).alias("action"))


@query(f"""WITH {CONV}, x AS (SELECT conv_id, turn, body, "role" role FROM cv) SELECT conv_id, turn, md5(trim(role) || chr(10) || chr(10) || 'Now: ' || trim(role)) without_examples_md5, md5(body) answer_md5, regexp_extract(trim(body), '^(\\w+)', 1) first_word FROM x""")
def prompt_surgery(s: SparkSession, d: str) -> DataFrame:
    """Examples between two markers go, of an answer what follows the last marker stays."""
    role, body = F.col("role"), F.col("body")
    whole = F.concat(role, F.lit("\nHere are some examples:\n"), body, F.lit("\n(END OF EXAMPLES)\nNow: "), role)
    said = F.concat(F.lit("Thought: no\nPrice Movement: maybe\nPrice Movement: "), body)
    return _turns(s, d).where(~body.contains("(END OF EXAMPLES)") & ~body.contains("Price Movement: ")).select(
        "conv_id", "turn", F.md5(T.remove_between(whole, "Here are some examples:", "(END OF EXAMPLES)")).alias("without_examples_md5"),
        F.md5(T.after_last(said, "Price Movement: ")).alias("answer_md5"), T.first_word(body).alias("first_word"),
    )


@query(f"""WITH {PRED}, a AS (SELECT sample_id, stock_return, ([' Long ', 'SHORT', 'long', 'hold', '', NULL, 'buy'])[sample_id % 7 + 1] act FROM pred)
 SELECT sample_id, round(1 / (1 + exp(-50 * CASE lower(trim(act)) WHEN 'long' THEN stock_return - 0.001 WHEN 'short' THEN -stock_return - 0.001 ELSE 0 END)), 6) utility FROM a""")
def utility_scores(s: SparkSession, d: str) -> DataFrame:
    act = F.element_at(F.array(*map(F.lit, (" Long ", "SHORT", "long", "hold", "", None, "buy"))), (F.col("sample_id") % 7 + 1).cast("int"))
    return X.predictions(s, d).select("sample_id", r(T.utility(act, F.col("stock_return")), 6).alias("utility"))


@query(f"""WITH {CONV} SELECT conv_id, turn, md5('Tokens: None Role: ' || "role") masked_md5, md5('Tokens: ' || body || ' Role: ' || "role") prompt_md5 FROM cv""")
def masked_tokens(s: SparkSession, d: str) -> DataFrame:
    """The ablation without tokens: their column masked, then rendered as ever; each prompt is told by its digest."""
    t, form = _turns(s, d), "Tokens: {tokens} Role: {role}"
    prompt = lambda tokens: F.md5(T.render(form, tokens=tokens, role=F.col("role")))
    return t.select("conv_id", "turn", prompt(F.lit(T.MASKED)).alias("masked_md5"), prompt(F.col("body")).alias("prompt_md5"))


@query("""SELECT k AS "table", n_rows, CASE WHEN k = 'conversations_unpaired' THEN 'unpaired' WHEN k = 'conversations_chosen' THEN 'preference' WHEN k = 'orders' THEN 'unknown' ELSE 'text' END kind FROM (SELECT 'documents' k, count(*) n_rows FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'orders', count(*) FROM orders
 UNION ALL SELECT 'conversations_unpaired', count(*) FROM conversations UNION ALL SELECT 'conversations_chosen', count(*) FROM conversations)""")
def dataset_kinds(s: SparkSession, d: str) -> DataFrame:
    c = X.read(s, d, "conversations")
    tables = {n: X.read(s, d, n) for n in ("documents", "benchmark", "orders")}
    tables["conversations_unpaired"] = c.select("conv_id", F.col("role").alias("prompt"), F.col("text").alias("completion"), (F.col("turn") > 0).alias("label"))
    tables["conversations_chosen"] = c.select("conv_id", F.col("text").alias("chosen"), F.col("role").alias("rejected"))
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(preference.dataset_kind(df)).alias("kind"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- scores at the edges of bins

EDGES = PRED + """, sharp AS (SELECT sample_id, k, true_label, list_transform(p, lambda x, i: CASE sample_id % 4 WHEN 0 THEN CASE WHEN i = sample_id % 5 + 1 THEN 1.0::DOUBLE ELSE 0 END WHEN 1 THEN CASE WHEN i = k THEN 0.6::DOUBLE ELSE 0.1 END WHEN 2 THEN CASE WHEN i = 2 THEN 3.0::DOUBLE ELSE 0 END ELSE pow(x, 6) END) p FROM pred),
 norm AS (SELECT sample_id, k, true_label, list_transform(p, lambda x: x / (list_sum(p) + 1e-9)) q FROM sharp)"""
BIN = "len(list_filter([i * 0.1::DOUBLE FOR i IN range(1, 10)], lambda e: {0} >= e))"


def _sharp(s: SparkSession, d: str) -> DataFrame:
    """Predictions of every certainty, not yet normalised: sure ones, even rests, sums above one, sharpened shares."""
    i, k = F.col("sample_id"), F.array_position(F.array(*map(F.lit, X.LABELS)), F.col("true_label"))
    pick = lambda j: F.transform("p", lambda x, n: F.when(n + 1 == j, 1.0).otherwise(0.0))
    p = F.when(i % 4 == 0, pick(i % 5 + 1)).when(i % 4 == 1, F.transform("p", lambda x, n: F.when(n + 1 == k, 0.6).otherwise(0.1))).when(i % 4 == 2, F.transform(pick(F.lit(2)), lambda x: 3 * x)).otherwise(F.transform("p", lambda x: F.pow(x, F.lit(6.0))))
    return X.predictions(s, d).withColumn("p", p)


@query(f"""WITH {EDGES}, x AS (SELECT k, unnest(q) v, unnest([1,2,3,4,5]) j FROM norm), b AS (SELECT j, {BIN.format("v")} bin, count(*) n, avg(v) cf, avg(CASE WHEN j = k THEN 1.0::DOUBLE ELSE 0 END) ac FROM x GROUP BY ALL), e AS (SELECT j, sum(n * abs(cf - ac)) / sum(n) e FROM b GROUP BY j) SELECT round(avg(e), 6) ece_macro FROM e""")
def calibration_error_edges(s: SparkSession, d: str) -> DataFrame:
    return metrics.ece(_sharp(s, d), X.LABELS).select(r("ece_macro", 6).alias("ece_macro"))


@query(f"""WITH {EDGES} SELECT CAST({BIN.format("list_max(q)")} AS BIGINT) bin, count(*) n, round(avg(list_max(q)), 6) confidence, round(avg(CASE WHEN list_position(q, list_max(q)) = k THEN 1.0::DOUBLE ELSE 0 END), 6) accuracy FROM norm GROUP BY ALL""")
def calibration_curve_edges(s: SparkSession, d: str) -> DataFrame:
    x = _sharp(s, d).withColumn("q", metrics.row_normalised(F.col("p")))
    right = F.element_at(F.array(*map(F.lit, X.LABELS)), F.array_position("q", F.array_max("q")).cast("int")) == F.col("true_label")
    c = metrics.calibration_curve(x, F.array_max("q"), right)
    return c.select("bin", "n", r("confidence", 6).alias("confidence"), r("accuracy", 6).alias("accuracy"))


# ---- baselines

TECHNICAL = ["ret_1d", "ret_5d", "ret_20d", "volatility_20d", "rsi_14", "price_vs_sma20", "bb_position", "volume_zscore_20", "gap_pct_last_day"]


def _feature_sets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples with labels, their technical features with the regime, and features of the news of their last three months."""
    b = saved(X.bars(s, d))
    i = indicators.indicators(b)
    technical = i.select("ticker", "date", *TECHNICAL).na.fill(0.0).join(indicators.market(i.select("date", "ret_1d")).select("date", "regime_label"), "date")
    day = F.to_date("timestamp_utc")
    weekly = X.news(s, d).select("ticker", F.date_trunc("quarter", day).cast("date").alias("quarter"), F.length("body").alias("chars"), F.col("body").rlike(r"\d").cast("int").alias("digits"))
    news = weekly.groupBy("ticker", "quarter").agg(F.count(F.lit(1)).cast("double").alias("n_news"), F.avg("chars").alias("news_chars"), F.avg("digits").alias("news_digits"))
    samples = _labelled(s, d, b).where("label_5 IS NOT NULL").select("ticker", "date", "label_5")
    before = F.add_months(F.date_trunc("quarter", F.col("date")).cast("date"), -3)  # a whole quarter that is over
    text = samples.select("ticker", "date", before.alias("quarter")).join(news, ["ticker", "quarter"], "left").drop("quarter").na.fill(0.0)
    return samples, technical, text


@query()
def fused_baseline(s: SparkSession, d: str) -> DataFrame:
    """Forests on technical features and on these with news features and regime dummies, beside the most frequent class."""
    samples, technical, text = _feature_sets(s, d)
    keys = ["ticker", "date"]
    rows = align.date_split(models.fused([samples, technical, text], keys, "regime_label")).persist()
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    sets = {"technical": TECHNICAL, "fused": models.numeric_features(rows, ())}
    out, classes = None, None
    for name, cols in sets.items():
        model = models.tree_baseline(train, cols, "label_5")
        classes = [str(x) for x in model.stages[0].labels]
        scores = models.scored(model, test, "label_5", []).withColumn("model", F.lit(name))
        out = scores if out is None else out.unionByName(scores)
    most = align.majority_class(train, "label_5").first()["label_5"]
    sure: Column = F.array(*[F.lit(1.0 if c == most else 0.0) for c in classes])
    out = out.unionByName(test.select(F.col("label_5").alias("true_label"), sure.alias("p"), F.lit(most).alias("pred_label"), F.lit("majority").alias("model")))
    report = models.model_report(out, classes)
    return report.select("model", *[r(c, 6).alias(c) for c in ("accuracy", "macro_f1", "mcc", "brier")])
