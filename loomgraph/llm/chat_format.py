"""Chat formatting by quotation linking, with DataFrame functions only.

Leading '>' marks give each line its quote level. Runs of lines of one level are passages; texts are lower-cased, white
space is made one space, and they are hashed. A passage asks for the whole of it, its paragraphs, lines and sentences;
messages offer those of their own words. A piece belongs to the earliest message of its conversation that offers its
hash, if that came earlier, and a passage to the message of its longest piece found, if that is COVERED of the passage's
letters. Passages that find none (quotes that begin or end within a sentence) ask for their stretches of SHINGLE words, and
belong to the message that the most of them belong to, if these are COVERED of all. So a quote from elsewhere that shares
a line, a sentence or a turn of phrase with a message stays unlinked, and so does one of under SHINGLE words that is no
whole line, sentence or text of a message. A message replies to the latest message that it quotes at the outermost level linked; deeper levels are
counted. Threads are found by pointer doubling over the replies, so every message gets its thread's first turn and its
depth; (thread_root, turn) is the reply order, for a reply comes later than what it quotes.

All messages are split into lines; their offers are filtered by the hashes asked for and aggregated to one row for each
conversation and hash before the join, so a hot conversation or a text repeated in it makes no pairs. The joins that hang
rows on a hot message have one row on the other side, so that adaptive execution can split the hot side. Conversations
are assembled in parts of at most PART_TURNS turns, and of about PART_ROWS messages where many share their turns.

Cases: null texts count as empty, and very long ones are read whole; empty passages link nothing; repeated rows stay rows
as messages, and a conversation holds such a message once; a null conversation or turn links nothing. Ties (messages of
one conversation and turn) share their links. Lines that announce a quote are left out where one follows, and kept
elsewhere. The template's marks in a text are escaped. Other columns do not pass. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

MARKS = r"^\s{0,3}((?:>\s?)+)"
ATTRIBUTION = r"^\s*(On|Am|Le|El)\b.*(wrote|schrieb|écrit|escribió)\b.*:\s*$"
SENTENCE = r"(?<=[.!?])\s+"
SHINGLE = 4
COVERED = 0.5
PART_TURNS, PART_ROWS = 256, 1024


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _pieces(df: DataFrame, column: str) -> DataFrame:
    """df with piece: distinct normal forms of the whole text of a column, its paragraphs, lines, sentences and those of each line."""
    text = F.col(column)
    lines = F.split(text, "\n")
    parts = F.concat(F.array(text), F.split(text, r"\n\s*\n"), lines, F.split(text, SENTENCE), F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE))))
    return df.withColumn("piece", F.explode(F.array_distinct(F.transform(parts, _normal)))).where("piece <> ''")


def _words(df: DataFrame, column: str) -> DataFrame:
    """df with words: those of a column, bare of the signs around them; white-space ones where nothing else is there."""
    bare = F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "))
    return df.withColumn("bare", bare).withColumn("words", F.split(F.when(F.col("bare") == "", _normal(F.col(column))).otherwise(F.col("bare")), " ")).drop("bare")


def _stretches(df: DataFrame) -> DataFrame:
    """df (words, size) with hash, of each stretch of size words."""
    starts = F.when(F.size("words") >= F.col("size"), F.sequence(F.lit(1), F.size("words") - F.col("size") + 1))
    rows = df.withColumn("at", F.explode(starts))
    return rows.withColumn("hash", F.xxhash64("size", F.array_join(F.slice("words", F.col("at"), F.col("size")), " "))).drop("at", "words")


def _by_stretches(left: DataFrame, bodies: DataFrame) -> DataFrame:
    """conv_id, turn, level, source of passages that no whole piece places, by stretches of words."""
    asked = _words(left, "passage").where(F.size("words") >= SHINGLE).withColumn("size", F.lit(SHINGLE))
    asked = stored(_stretches(asked.select("conv_id", "turn", "level", "id", "size", "words")).distinct())
    whole = asked.groupBy("conv_id", "turn", "level", "id").agg(F.count(F.lit(1)).alias("all"))
    offers = _words(bodies.join(asked.select("conv_id").distinct(), "conv_id", "left_semi"), "body").select("conv_id", "turn", "words")
    offers = _stretches(offers.join(asked.select("conv_id", "size").distinct(), "conv_id"))
    offers = offers.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    offers = stored(offers.groupBy("conv_id", "hash").agg(F.min("turn").alias("source")))
    found = asked.join(offers, ["conv_id", "hash"]).where("source < turn").groupBy("conv_id", "turn", "level", "id", "source").agg(F.count(F.lit(1)).alias("n"))
    best = found.groupBy("conv_id", "turn", "level", "id").agg(F.max(F.struct("n", (-F.col("source")).alias("s"))).alias("b"))
    sure = best.join(whole, ["conv_id", "turn", "level", "id"]).where(F.col("b.n") >= COVERED * F.col("all"))
    return sure.select("conv_id", "turn", "level", (-F.col("b.s")).alias("source"))


def _with_body(messages: DataFrame) -> DataFrame:
    """messages with body: the text without quoted lines and the lines that announce them."""
    lines = messages.withColumn("lines", F.split("text", "\n"))
    quoted = lambda x: F.coalesce(x.rlike(MARKS), F.lit(False))
    line = lambda i: F.get("lines", i)
    announced = lambda i: quoted(line(i + 1)) | (F.coalesce(F.trim(line(i + 1)) == "", F.lit(False)) & quoted(line(i + 2)))
    own = F.filter("lines", lambda x, i: ~quoted(x) & ~(x.rlike(ATTRIBUTION) & announced(i)))
    return lines.withColumn("body", F.array_join(own, "\n")).drop("lines")


def _links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_linked of the messages (conv_id, turn, role, text, body) that quote earlier ones."""
    named = messages.where("conv_id is not null and turn is not null")
    quoting = named.where(F.col("text").rlike(r"(?m)" + MARKS)).select("conv_id", "turn", F.xxhash64("role", "text").alias("own"), "text").distinct()
    lines = quoting.select("conv_id", "turn", "own", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("level", F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 1), "[^>]", ""))).where("level > 0")
    run = Window.partitionBy("conv_id", "turn", "own", "level").orderBy("at")
    lines = lines.withColumn("run", F.col("at") - F.row_number().over(run)).withColumn("line", F.regexp_replace("line", MARKS, ""))
    passage = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    passages = lines.groupBy("conv_id", "turn", "own", "level", "run").agg(passage.alias("passage")).where(_normal(F.col("passage")) != "")
    passages = stored(passages.select("conv_id", "turn", "level", F.xxhash64("own", "run").alias("id"), "passage"))
    asked = stored(_pieces(passages, "passage").select("conv_id", "turn", "level", "id", F.length("piece").alias("size"), F.xxhash64("piece").alias("hash"), F.length(_normal(F.col("passage"))).alias("whole")).where(F.col("size") >= COVERED * F.col("whole")).drop("whole"))
    offers = _pieces(named, "body").select("conv_id", "turn", F.xxhash64("piece").alias("hash"))
    offers = offers.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    offers = stored(offers.groupBy("conv_id", "hash").agg(F.min("turn").alias("source")))
    longest = F.max(F.struct("size", (-F.col("source")).alias("s")))
    placed = asked.join(offers, ["conv_id", "hash"]).where("source < turn").groupBy("conv_id", "turn", "level", "id").agg(longest.alias("b"))
    placed = stored(placed.select("conv_id", "turn", "level", "id", (-F.col("b.s")).alias("source")))
    left = stored(passages.join(placed, ["conv_id", "turn", "level", "id"], "left_anti"))
    linked = placed.drop("id").unionByName(_by_stretches(left, named))
    outer = F.min(F.struct("level", (-F.col("source")).alias("s")))
    return linked.groupBy("conv_id", "turn").agg(outer.alias("o"), F.count(F.lit(1)).alias("n_linked")).select("conv_id", "turn", (-F.col("o.s")).alias("reply_to"), "n_linked")


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_linked, thread_root, depth, by pointer doubling; rounds grow as the depth's logarithm."""
    now = stored(links.withColumn("thread_root", F.col("reply_to")).withColumn("depth", F.lit(1).cast("long")).withColumn("open", F.lit(True)))
    while not now.where("open").isEmpty():
        above = now.select("conv_id", F.col("turn").alias("thread_root"), F.col("thread_root").alias("r"), F.col("depth").alias("d"), F.lit(True).alias("more"))
        moved = now.where("open").join(above, ["conv_id", "thread_root"], "left")
        moved = moved.select("conv_id", "turn", "reply_to", "n_linked", F.coalesce("r", "thread_root").alias("thread_root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.coalesce("more", F.lit(False)).alias("open"))
        now = stored(now.where("not open").unionByName(moved))
    return now.drop("open")


def format_chats(conversations: DataFrame, template: str = "<|%s|>\n%s\n<|end|>") -> DataFrame:
    """conv_id, turn, role, reply_to, thread_root, depth, n_linked, text (without quotes) and formatted, a row a message.

    thread_root is the turn itself for a message that replies to none."""
    messages = conversations.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    messages = stored(_with_body(messages))
    out = messages.join(threads(_links(messages)), ["conv_id", "turn"], "left").withColumn("own", F.regexp_replace("body", r"^\s+|\s+$", ""))
    shown = F.format_string(template, F.coalesce("role", F.lit("user")), F.replace("own", F.lit("<|"), F.lit("<\\|")))
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("thread_root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("own").alias("text"), shown.alias("formatted"))


def assemble(messages: DataFrame) -> DataFrame:
    """conv_id, thread_root, part, subpart, n_messages, n_linked, turns, replies (what each turn replies to) and text of
    format_chats' messages: the reply-ordered conversations, a row a part. part counts PART_TURNS turns from 0 on."""
    keys = ["conv_id", "thread_root", "part"]
    rows = messages.select("conv_id", "thread_root", F.floor(F.col("turn") / PART_TURNS).alias("part"), "turn", "reply_to", "n_linked", "role", "formatted").distinct()
    rows = stored(rows)
    size = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts")).where("parts > 1")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    rows = rows.alias("r").join(size.alias("s"), same, "left").select("r.*", F.coalesce("parts", F.lit(1)).alias("parts"))
    rows = rows.withColumn("subpart", F.pmod(F.xxhash64("role", "formatted"), "parts"))
    line = F.struct("turn", F.col("role"), "formatted", "reply_to", "n_linked")
    parts = rows.groupBy(*keys, "subpart").agg(F.array_sort(F.collect_list(line)).alias("m"))
    each = lambda name: F.transform("m", lambda x: x[name])
    linked = F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x["n_linked"])
    return parts.select(*keys, "subpart", F.size("m").cast("long").alias("n_messages"), linked.alias("n_linked"), each("turn").alias("turns"), each("reply_to").alias("replies"), F.array_join(each("formatted"), "\n").alias("text"))


def quoted_replies(conversations: DataFrame) -> DataFrame:
    """conversations with quotes put before each message, for the given table holds none: of the message before, on even
    turns all its lines, on odd ones the latter half of its words, from within a line on; on every third turn, of the
    message before that one as a deeper level; on every fourth with a line that announces them."""
    messages = conversations.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    near = lambda step, name: messages.where("text is not null").groupBy("conv_id", (F.col("turn") + step).alias("turn")).agg(F.min("text").alias(name))
    words = F.split(F.trim("before"), r"\s+")
    half = F.array_join(F.slice(words, F.floor(F.size(words) / 2).cast("int") + 1, F.size(words)), " ")
    quote = F.when(F.pmod("turn", F.lit(2)) == 0, F.col("before")).otherwise(half)
    marked = lambda mark, text: F.concat(F.lit(mark + " "), F.regexp_replace(text, "\n", f"\n{mark} "))
    deeper = F.when(F.pmod("turn", F.lit(3)) == 2, marked(">>", F.col("earlier")))
    announced = F.when(F.pmod("turn", F.lit(4)) == 1, F.concat(F.lit("On day "), F.col("turn").cast("string"), F.lit(" someone wrote:")))
    text = F.when(F.col("before").isNotNull(), F.concat_ws("\n", announced, deeper, marked(">", quote), "text")).otherwise(F.col("text"))
    return messages.join(near(1, "before"), ["conv_id", "turn"], "left").join(near(2, "earlier"), ["conv_id", "turn"], "left").select("conv_id", "turn", "role", text.alias("text"))


def op5_query(spark, sf_dir: str) -> DataFrame:
    from .tables import read

    return assemble(format_chats(stored(quoted_replies(read(spark, sf_dir, "conversations")))))
