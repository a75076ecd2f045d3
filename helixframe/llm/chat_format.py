r"""Chat formatting by relational operations (operator 9). Spark expressions only.

A conversation becomes one string of turns, each

    ### role: text
    </turn>

Adjacent turns of one role become one turn whose texts stand apart by a line ``</part>``.
Inside texts, a control string, with the backslashes before it if any, gets one backslash more;
so a marker with none before it is the template's own, and taking one away gives the text back.
Markers are told apart even after a text that ends in a backslash, since a line feed
always stands between the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, PART, HEAD = "\n</turn>\n", "\n</part>\n", "### "
#: The strings that texts may not hold as they are.
CONTROL = r"(### |</turn>|</part>)"


#: Code points of a block that ``read_back`` cuts the output into.
BLOCK = 1024


def escape(text: Column) -> Column:
    """One backslash more before each control string. A run of backslashes is looked at once, from
    its begin and without going back, so that long runs cost no more than other text."""
    return F.regexp_replace(text, r"(?<!\\)(\\*+)" + CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)" + CONTROL, "$1$2")


def _role(role: Column) -> Column:
    """Backslash, colon and line feed escaped, so that the first ': ' ends the role."""
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\c"), F.lit(":")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """One row a conversation: ``conv_id``, ``formatted`` string and ``loss_spans``
    array<struct<at int, size int>>, the code points of ``formatted``, from 0, that a model
    learns: each text of the ``learned`` role, escaped, without markers.

    Rows are grouped by conversation, sorted by turn (then role and text, for repeated turns),
    and merged where neighbours have one role; a null text or role counts as empty, a null
    turn comes first, and rows with a null ``conv_id`` make up one conversation. An empty
    table gives no rows. Other columns are ignored. A conversation is one row by the contract,
    so it must fit in one; no other grouping is done.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    # where a run of one role begins, and so where the one before it ends
    roles, none = F.col("turns.role"), F.array(F.lit(None).cast("string"))
    n = F.size("turns")
    sides = F.arrays_zip(F.col("turns").alias("turn"), F.concat(none, F.slice(roles, 1, n - 1)).alias("before"), F.concat(F.slice(roles, 2, n - 1), none).alias("after"))
    begins = F.filter(F.transform(sides, lambda x, i: F.when(~x["turn"]["role"].eqNullSafe(x["before"]), i + 1)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(sides, lambda x, i: F.when(~x["turn"]["role"].eqNullSafe(x["after"]), i + 1)), lambda i: i.isNotNull())
    runs = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("at"), (b - a + 1).alias("size")))
    chats = chats.withColumn("runs", runs)
    merged = F.transform("runs", lambda r: F.slice("turns", r["at"], r["size"]))
    # one piece a text: its role, what the template puts before and after it, and its escaped text
    pieces = F.flatten(
        F.transform(
            merged,
            lambda run: F.transform(
                run,
                lambda t, i: F.struct(
                    t["role"].alias("role"),
                    F.when(i == 0, F.concat(F.lit(HEAD), _role(t["role"]), F.lit(": "))).otherwise("").alias("before"),
                    escape(t["text"]).alias("text"),
                    F.when(i == F.size(run) - 1, TURN).otherwise(PART).alias("after"),
                ),
            ),
        )
    )
    chats = chats.withColumn("pieces", pieces).drop("turns", "runs")
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    return chats.select("conv_id", formatted.alias("formatted"), _spans(F.col("pieces"), learned).alias("loss_spans"))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda total, size: total + size)


def _starts(sizes: Column) -> Column:
    """The sum of all sizes before each. It is made from sums of blocks of about the square root of
    their number, so that many turns don't cost their square."""

    def of_blocks(blocks: Column) -> Column:
        starts = _once(F.transform(blocks, _sum), lambda sums: F.transform(sums, lambda _, b: _sum(F.slice(sums, 1, b))))
        return F.flatten(F.zip_with(starts, blocks, lambda start, block: F.transform(block, lambda _, i: start + _sum(F.slice(block, 1, i)))))

    def cut(own: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(own))).cast("int"), F.lit(1))
        return _once(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / w).cast("int")), lambda b: F.slice(own, b * w + 1, w)))

    return _once(sizes, lambda own: _once(cut(own), of_blocks))


def _spans(pieces: Column, learned: str) -> Column:
    """Where the learned texts stand."""
    sizes = F.transform(pieces, lambda p: F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"]))
    spans = F.zip_with(pieces, _starts(sizes), lambda p, a: F.when(p["role"] == learned, F.struct((a + F.length(p["before"])).alias("at"), F.length(p["text"]).alias("size"))))
    return F.filter(spans, lambda s: s.isNotNull())


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` (as ``format_chats`` gives them) plus what their output alone says: ``turns``
    array<struct<role, text>>, one for each text formatted, and ``learned`` array<string>, the
    texts under the loss spans."""
    blocks = F.filter(F.split(F.col("formatted"), r"\n</turn>\n", -1), lambda b: b != "")

    def texts(block: Column) -> Column:
        head = F.instr(block, ": ")
        role = _role_back(F.substring(block, F.lit(len(HEAD) + 1), head - len(HEAD) - 1))
        return F.transform(F.split(F.substr(block, head + 2), r"\n</part>\n", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    # a span is read from the blocks it lies in: counting to it from the begin would cost the square
    cut = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    first, last = lambda s: F.floor(s["at"] / BLOCK).cast("int"), lambda s: F.floor((s["at"] + s["size"]) / BLOCK).cast("int")
    text = lambda own, s: F.substring(F.array_join(F.slice(own, first(s) + 1, last(s) - first(s) + 1), ""), s["at"] % BLOCK + 1, s["size"])
    learned = _once(cut, lambda own: F.transform("loss_spans", lambda s: unescape(text(own, s))))
    return chats.withColumn("turns", F.flatten(F.transform(blocks, texts))).withColumn("learned", learned)
