"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document. A visitor flattens the parts in order into one
string: text is escaped, every other part becomes a numbered placeholder (numbered through the conversation), its
reference is recorded as an attachment and its expanded token count is taken from its units.

Template: ``<s>[role]content</s>`` for each turn. Inside roles and texts the characters that control strings of chat
templates are made of are replaced by two-character codes, so no text can open or close a turn, and the codes are
read back without loss.

Defined cases: a null text or null parts are empty; a null role is the empty role; a null turn sorts first; rows
with equal turns are ordered by role and content, and repeated rows are repeated turns; null conversation ids form
one conversation; an empty table gives an empty table; extra input columns are left out. A conversation becomes one
string, so one conversation (not one user or one source) has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template. A backslash never stands in escaped text but as the start of a code.
CODES = (("\\", "\\e"), ("<", "\\l"), (">", "\\g"), ("[", "\\b"), ("]", "\\d"))
OPEN, ROLE_END, CLOSE = "<s>[", "]", "</s>"

#: Tokens that one unit of a part stands for: an image's 14 x 14 patch, a second of audio, a page of a document.
TOKENS_A_UNIT = {"image": 1, "audio": 25, "document": 600}
PART = "struct<kind:string,text:string,uri:string,units:bigint>"


def escaped(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as a list with one text part."""
    none = F.lit(None)
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("uri"), none.cast("bigint").alias("units"))
    return F.array(part)


def _attached(parts: Column) -> Column:
    return F.filter(parts, lambda p: p["kind"] != "text")


def _tokens(part: Column) -> Column:
    rate = F.lit(0)
    for kind, n in TOKENS_A_UNIT.items():
        rate = F.when(part["kind"] == kind, F.lit(n)).otherwise(rate)
    return (rate * F.coalesce(part["units"], F.lit(0))).cast("bigint")


def visited(parts: Column, before: Column) -> Column:
    """Flatten the parts of a message into its content; ``before`` attachments stand earlier in the conversation."""
    step = lambda acc, p: F.when(
        p["kind"] == "text", F.struct(F.concat(acc["content"], escaped(F.coalesce(p["text"], F.lit("")))).alias("content"), acc["n"].alias("n"))
    ).otherwise(
        F.struct(F.concat(acc["content"], F.lit("<"), escaped(p["kind"]), F.lit(":"), acc["n"].cast("string"), F.lit(">")).alias("content"), (acc["n"] + 1).alias("n"))
    )
    return F.aggregate(parts, F.struct(F.lit("").alias("content"), before.cast("bigint").alias("n")), step, lambda acc: acc["content"])


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row for each conversation.

    Returns ``conv_id``, ``formatted``, ``loss_spans`` (array of start and length in code points, for the texts of
    assistant turns), ``attachments`` (array of number, kind, uri, units, tokens, in order) and ``n_tokens_attached``.
    """
    clean = F.transform(
        F.filter(F.coalesce(F.col(f"`{parts_col}`").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()),
        lambda p: p.withField("kind", F.coalesce(p["kind"], F.lit("text"))),
    )
    turn = F.struct(
        F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), clean.alias("parts")
    )
    # Numbers of attachments and places in the output are running sums over the turns of a conversation.
    turns = messages.select(F.col(f"`{conv_col}`").alias("conv_id"), turn.alias("message"))
    order = Window.partitionBy("conv_id").orderBy("message")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("before", F.coalesce(F.sum(F.size(_attached(F.col("message.parts")))).over(earlier), F.lit(0)))
    body = turns.select("conv_id", "message", escaped(F.col("message.role")).alias("role"), visited(F.col("message.parts"), F.col("before")).alias("content"))
    head = F.length("role") + len(OPEN + ROLE_END)
    width = (head + F.length("content") + len(CLOSE)).cast("bigint")
    placed = body.withColumns({"at": F.coalesce(F.sum(width).over(earlier), F.lit(0)), "number": F.row_number().over(order)})
    line = F.concat(F.lit(OPEN), "role", F.lit(ROLE_END), "content", F.lit(CLOSE))
    span = F.when(F.col("message.role") == "assistant", F.struct((F.col("at") + head).cast("bigint").alias("start"), F.length("content").cast("bigint").alias("length")))
    row = F.struct("number", line.alias("line"), span.alias("span"), _attached(F.col("message.parts")).alias("attached"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    whole = whole.select("conv_id", "rows", F.flatten(F.transform("rows", lambda r: r["attached"])).alias("attached"))
    found = F.transform("attached", lambda p, i: F.struct(i.cast("bigint").alias("number"), p["kind"].alias("kind"), p["uri"].alias("uri"), p["units"].alias("units"), _tokens(p).alias("tokens")))
    return whole.select(
        "conv_id", F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("formatted"), F.array_compact(F.transform("rows", lambda r: r["span"])).alias("loss_spans"), found.alias("attachments"),
        F.aggregate(F.transform("attached", _tokens), F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n_tokens_attached"),
    )


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation as an array of role and text. Placeholders stay in the text as they are."""
    turns = F.filter(F.split(formatted, r"<s>\["), lambda t: t != "")
    parsed = lambda t: F.struct(
        unescaped(F.substring_index(t, ROLE_END, 1)).alias("role"),
        unescaped(F.replace(F.substring(t, F.instr(t, ROLE_END) + 1, F.length(t)), F.lit(CLOSE), F.lit(""))).alias("text"),
    )
    return F.transform(turns, parsed)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
