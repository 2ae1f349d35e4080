"""Chat formatting with Spark expressions only: turns to template text, and back.

A run of turns of one role is one block: a start mark, the role, a newline, the texts with a turn
mark between them, an end mark, a newline. Control strings inside texts are escaped reversibly, so
reading back gives the turns as they were, and the loss mask (spans of assistant text in the
formatted string, code points) holds each assistant text once with no marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TURN = "<|im_start|>", "<|im_end|>", "<|im_turn|>"


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one inside every `<|`: no control string is left in the text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length over code points of formatted).

    turns: conv_id, turn, role, text, a row per turn. Turns are sorted by (turn, role, text); ties and
    repeated rows are kept, each a turn. Null text and null role: empty. Null conv_id is one
    conversation of its own. No turns: no rows. A conversation must fit one row, as its text does.
    Roles are URL-encoded in the output (plain names stay as they are). Further columns are ignored.
    """
    t = turns.select(
        F.col("conv_id"), F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    sorted_turns = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # a column of its own: `turns.role` would be taken out of all turns again at each place
    sorted_turns = sorted_turns.withColumn("roles", F.transform("turns", lambda x: x["role"]))
    n = F.size("turns")
    # where runs of one role begin; each run is cut out of the sorted array and merged
    heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("roles", i) != F.get("roles", i - 1)))
    runs = sorted_turns.withColumn("heads", heads).withColumn(
        "runs",
        F.transform(
            "heads",
            lambda h, j: F.struct(
                F.get("roles", h).alias("role"),
                F.transform(F.slice("turns", h + 1, F.coalesce(F.get("heads", j + 1), n) - h), lambda x: escape(x["text"])).alias("texts"),
            ),
        ),
    )
    header = lambda r: F.concat(F.lit(START), F.url_encode(r["role"]), F.lit("\n"))
    blocks = runs.select(
        "conv_id",
        F.transform("runs", lambda r: F.concat(header(r), F.array_join(r["texts"], TURN), F.lit(END + "\n"))).alias("blocks"),
        F.transform("runs", lambda r: F.struct((r["role"] == "assistant").alias("learn"), F.length(header(r)).alias("head"), F.transform(r["texts"], lambda x: F.length(x)).alias("sizes"))).alias("parts"),
    )
    # positions of the texts: a running sum over pieces (text lengths and the marks after them), one pass
    tail = F.lit(len(END) + 1)
    pieces = F.flatten(
        F.transform(
            "parts",
            lambda p: F.transform(
                p["sizes"],
                lambda s, i: F.struct(
                    p["learn"].alias("learn"), F.when(i == 0, p["head"]).otherwise(len(TURN)).alias("lead"), s.alias("size"), F.when(i == F.size(p["sizes"]) - 1, tail).otherwise(0).alias("trail")
                ),
            ),
        )
    )
    return (
        blocks.withColumn("pieces", pieces)
        .withColumn("sums", _block_sums("pieces"))
        .withColumn("spans", _positions("pieces", "sums"))
        .select("conv_id", F.array_join("blocks", "").alias("formatted"), F.transform(F.filter("spans", lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["size"].alias("length"))).alias("loss_spans"))
    )


def _width(p: Column) -> Column:
    return p["lead"] + p["size"] + p["trail"]


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, p: a + _width(p))


def _block(pieces: str) -> Column:
    return F.greatest(F.ceil(F.sqrt(F.size(pieces))).cast("int"), F.lit(1))


def _block_sums(pieces: str) -> Column:
    """Lengths of the square root of n blocks of as many pieces."""
    block = _block(pieces)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / block).cast("int")), lambda b: _total(F.slice(pieces, b * block + 1, block)))


def _positions(pieces: str, sums: str) -> Column:
    """Adds to each piece its start: lengths of all earlier pieces, summed block-wise so that a long
    conversation costs n times sqrt(n), not n squared. The sums are named twice, so that they stay a column
    and are not made again for each piece."""
    block = _block(pieces)
    zero = F.lit(0).cast("long")
    at = F.transform(
        F.sequence(F.lit(0), F.size(pieces) - 1),
        lambda i: F.struct(
            F.get(pieces, i)["learn"].alias("learn"),
            F.get(pieces, i)["size"].alias("size"),
            (
                F.aggregate(F.slice(sums, F.lit(1), F.floor(i / block).cast("int")), zero, lambda a, s: a + s)
                + _total(F.slice(pieces, F.floor(i / block).cast("int") * block + 1, i - F.floor(i / block).cast("int") * block))
                + F.get(pieces, i)["lead"]
            ).alias("start"),
        ),
    )
    return F.when(F.size(sums) > 0, at)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_texts: parsed from the formatted text and its spans."""
    blocks = F.filter(F.split("formatted", "<\\|im_end\\|>\n", -1), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.locate("\n", b) + 1), "<\\|im_turn\\|>", -1),
                lambda x: F.struct(F.url_decode(F.substr(b, F.lit(len(START) + 1), F.locate("\n", b) - 1 - len(START))).alias("role"), unescape(x).alias("text")),
            ),
        )
    )
    cut = formatted.withColumn("_size", F.length("formatted")).withColumn("_wide", _chunks("formatted", F.col("_size"), WIDE))
    cut = cut.withColumn("_chunks", F.flatten(F.transform("_wide", lambda x: _chunks(x, F.length(x), CHUNK))))
    # the chunks are named twice, so that they stay a column and are not made again for each span
    loss = F.when(F.size("_chunks") > 0, F.transform("loss_spans", lambda s: unescape(_under("_chunks", s["start"], s["length"]))))
    return cut.select("conv_id", turns.alias("turns"), loss.alias("loss_texts"), F.col("_size").cast("long").alias("formatted_chars"))


#: Code points of the chunks that spans are read from: a substring is counted from the start of its text, so
#: spans of a long text are taken from short pieces of it.
WIDE, CHUNK = 1 << 18, 1 << 11


def _chunks(text: Column | str, size: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / width).cast("int") - 1, F.lit(0))), lambda k: F.substr(text, k * width + 1, F.lit(width)))


def _under(chunks: str, start: Column, length: Column) -> Column:
    """The code points of a span, from the chunks that it touches."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor((start + length) / CHUNK).cast("int")
    return F.substr(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), (start - first * CHUNK + 1).cast("int"), length)


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, from what is read back."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars"
    )
