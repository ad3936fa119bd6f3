"""Line dedup by winnowing over line hashes, in DataFrame functions alone (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    """Array of the lines that have a word: position, two hashes (128 bits that tell lines apart), words."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("pos"), F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"), F.regexp_count(line, F.lit(WORD)).alias("words")))
    return F.filter(lines, lambda x: x["words"] > 0)


def _made(lines: list[Column]) -> Column:
    """A window of these lines: its fingerprint (the least line hash, selected by winnowing), how many lines lie
    before that one, two hashes of its contents, and the positions it covers."""
    k, least = len(lines), lines[0]["h"]
    if k > 1:
        least = F.least(*[y["h"] for y in lines])
    back = F.coalesce(*[F.when(y["h"] == least, F.lit(n)) for n, y in enumerate(lines)]).cast("byte")
    return F.struct(
        least.alias("fingerprint"),
        back.alias("back"),
        F.xxhash64(F.lit(k), *[y["h"] for y in lines]).alias("content"),
        F.xxhash64(F.lit(k), *[y["g"] for y in lines]).alias("content2"),
        lines[0]["pos"].alias("pos"),
        F.array(*[y["pos"] for y in lines]).alias("covers"),
    )


def _window(at: list[Column], min_words: int) -> Column:
    """The window that opens at the first of these lines: the fewest that have `min_words` words, or all; null at the end."""
    total, pick = F.lit(0), None
    for k, x in enumerate(at, 1):
        total = total + x["words"]
        made = _made(at[:k])
        ok = (total >= min_words) if k < len(at) else x["h"].isNotNull()
        pick = F.when(ok, made) if pick is None else pick.when(ok, made)
    return pick


def _tails(at: list[Column], min_words: int) -> list[Column]:
    """Windows that close where they do: the fewest lines up to a last one, where they are not the fewest from their first.

    Of the windows that open at the first of these lines, each is null or has the fields of _window().
    """
    out = []
    for k in range(2, len(at) + 1):
        head, tail = F.lit(0), F.lit(0)
        for x in at[: k - 1]:
            head = head + x["words"]
        for x in at[1:k]:
            tail = tail + x["words"]
        out.append(F.when((head >= min_words) & (tail < min_words), _made(at[:k])))
    return out


def repeated_runs(docs: DataFrame, min_lines: int = 3, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", extend: bool = True) -> DataFrame:
    """(id, print, runs): for each document with repeated lines, the maximal runs [first, last] to delete.

    1. Winnowing: every window of lines selects its least line hash as a fingerprint. Any run that counts has a
       whole window inside, and equal windows select the same line, so two equal runs share a fingerprint.
    2. Fingerprints are joined with the place, by (id, hash of the text, line), where the same one first stands
       in the same surroundings: the lines of the window before and after it, as many (`back`, in the content).
       A line that a third of all documents hold cannot be joined with every earlier place, and its first place
       alone may have other neighbours; with the surroundings in the key no two documents are ever paired.
    3. A match is extended in both directions by looking up the next window on either side in the same way;
       those with an earlier place of their own join up to a maximal run. Windows are the fewest lines from a
       first one on, which reach back to the run's first line, and the fewest up to a last one, which reach on
       to its last: any run that counts and stands earlier is covered by those inside it. Without extend there
       are no windows of the second kind, and short lines at a run's end stay.
    The first place is aggregated before the shuffle: a hot line is one row for each task.
    """
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).where(F.col("t").isNotNull())
    lines = base.select("id", F.xxhash64("t").alias("print"), _lines(F.col("t")).alias("full"))
    ahead = F.arrays_zip(*[(F.col("full") if k == 0 else F.slice("full", k + 1, F.size("full"))).alias(f"x{k}") for k in range(min_lines)])
    opened = lines.select("id", "print", F.inline(ahead).alias(*[f"x{k}" for k in range(min_lines)])).where(F.col("x0").isNotNull())
    at = [F.col(f"x{k}") for k in range(min_lines)]
    if extend:
        windows = opened.select("id", "print", F.inline(F.array_compact(F.array(_window(at, min_words), *_tails(at, min_words)))))
    else:
        windows = opened.select("id", "print", _window(at, min_words).alias("w")).where("w is not null").select("id", "print", "w.*")
    windows = stored(windows, "line-windows")
    place = F.struct("id", "print", "pos")
    same = ["fingerprint", "back", "content", "content2"]
    firsts = windows.groupBy(*same).agg(F.min(place).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(firsts, same).where(place > F.col("low"))
    marks = later.groupBy("id", "print").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("covers")))).alias("m"))
    starts = F.filter("m", lambda x, i: (i == 0) | (F.get(F.col("m"), i - 1) < x - 1))
    ends = F.filter("m", lambda x, i: F.coalesce(F.get(F.col("m"), i + 1) > x + 1, F.lit(True)))
    return marks.select("id", "print", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_lines: int = 3, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", report: bool = False, extend: bool = True) -> DataFrame:
    """docs with repeated runs of lines deleted from the text; the first occurrence, by (id, text hash, line), stays.

    A run is repeated if it has `min_words` words or `min_lines` lines and stands at an earlier place; lines
    are compared exactly, lines without a word (spaces, tabs, line ends) are neither compared nor deleted.
    Without extend, lines go only inside the fewest-lines windows that open at one of them.
    report adds n_lines, n_removed and n_runs. Null text stays null (0 lines); empty text stays empty (1 line);
    null ids come before all others; rows alike in id and text are one document and keep the same lines; other
    columns pass through untouched; an empty table gives no rows; a document that loses every line keeps its
    row with an empty text.
    """
    prepare(docs.sparkSession)
    runs = repeated_runs(docs, min_lines, min_words, id_col, text_col, extend)
    runs = runs.select(F.col("id").alias("i"), F.col("print").alias("p"), "runs")
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"), docs[text_col].alias("t"))
    rows = rows.join(runs, rows["id"].eqNullSafe(runs["i"]) & (F.xxhash64(rows["t"]) == runs["p"]), "left").select("row", "t", "runs")
    lines = F.split("t", "\n", -1)
    keep = F.transform(
        F.sequence(F.lit(0), F.size("runs")),
        lambda k: F.struct(F.coalesce(F.get(F.col("runs"), k - 1)["last"] + 1, F.lit(0)).alias("a"), F.coalesce(F.get(F.col("runs"), k)["first"], F.size("lines")).alias("b")),
    )
    rows = rows.select("row", "t", "runs", F.when(F.col("runs").isNotNull(), lines).alias("lines"))
    kept = F.flatten(F.transform(keep, lambda s: F.slice(F.col("lines"), s["a"] + 1, s["b"] - s["a"])))
    text = F.when(F.col("runs").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n"))
    out = rows.select(F.col("row").withField(text_col, text).alias("row"), "t", "runs")
    if not report:
        return out.select("row.*")
    n_lines = F.coalesce(F.regexp_count("t", F.lit("\n")) + 1, F.lit(0)).cast("long")
    gone = F.coalesce(F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1), F.lit(0)).cast("long")
    return out.select("row.*", n_lines.alias("n_lines"), gone.alias("n_removed"), F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"))
