"""Tables of a folder, and plain texts as pages of positioned words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.functions.tokens import let, line_marker, split_words
from leafscan.plans.shared import taken_apart

#: Layout of plain texts: words of a line, and the grid they are set on.
LINE_WORDS = 10
LEFT, TOP, COLUMN, LINE, CHAR, HEIGHT, LONGEST = 100, 100, 240, 40, 20, 30, 11


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, by Spark's reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a small input has fewer partitions than there are cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pages_of_texts(texts: DataFrame, page_id: str, text: str) -> DataFrame:
    """page_id, ws (array of words) from any table of texts."""
    return texts.select(F.col(page_id).alias("page_id"), F.coalesce(split_words(F.col(text)), F.expr("cast(array() as array<string>)")).alias("ws"))


def laid_out(word: Column, pos: Column) -> dict[str, Column]:
    """Box of the word at a position (from 0) when a text is laid out line by line."""
    x1 = LEFT + COLUMN * (pos % LINE_WORDS)
    y1 = TOP + LINE * F.floor(pos / LINE_WORDS)
    sides = {"x1": x1, "y1": y1, "x2": x1 + CHAR * F.least(F.length(word), F.lit(LONGEST)), "y2": y1 + HEIGHT}
    return {name: side.cast("double") for name, side in sides.items()}


def placed(pos: int, length: int) -> tuple[int, int, int, int]:
    """The same box, of one word of a length."""
    x1, y1 = LEFT + COLUMN * (pos % LINE_WORDS), TOP + LINE * (pos // LINE_WORDS)
    return x1, y1, x1 + CHAR * min(length, LONGEST), y1 + HEIGHT


def word_boxes(pages: DataFrame) -> DataFrame:
    """page_id, pos, word, line_no, x1, y1, x2, y2: the words of laid-out pages."""
    words = taken_apart(pages, "ws", "pos", "word", "page_id")
    boxes = [side.alias(name) for name, side in laid_out(F.col("word"), F.col("pos")).items()]
    return words.select("page_id", "pos", "word", F.floor(F.col("pos") / LINE_WORDS).cast("int").alias("line_no"), *boxes)


def marker_text(ws: Column) -> Column:
    """Marker text of a laid-out page: one paragraph, each line opened by its box."""

    def marked(words: Column) -> Column:
        def with_marker(word: Column, pos: Column) -> Column:
            last = F.least(pos + LINE_WORDS - 1, F.size(words) - 1)
            first_box, last_box = laid_out(word, pos), laid_out(F.element_at(words, last + 1), last)
            marker = line_marker(first_box["x1"], first_box["y1"], last_box["x2"], last_box["y2"])
            return F.when(pos % LINE_WORDS == 0, F.concat(marker, F.lit(" "), word)).otherwise(word)

        return F.array_join(F.concat(F.array(F.lit("[[PARAGRAPH]]")), F.transform(words, with_marker)), " ")

    return let(ws, marked)
