"""Datasets as file relations: classes by path, pairing, splits, name checks, grouping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_of(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.element_at(F.split(name_of(path), r"\."), 1)


def parent_of(path: Column, level: int = 1) -> Column:
    """The name of the folder `level` above the file; null where the path is shorter."""
    return F.try_element_at(F.split(path, "/"), F.lit(-1 - level))


def is_image(path: Column) -> Column:
    return path.rlike(r"\.(tif|tiff|TIF|TIFF)$")


def classify(files: DataFrame, mark: str = "synthetic", truth: str = "gt") -> DataFrame:
    """is_synthetic: a path component equals the mark; is_truth: the path mentions the truth tag."""
    return files.withColumns({"is_synthetic": F.array_contains(F.split("path", "/"), mark), "is_truth": F.contains(F.col("path"), F.lit(truth))})


def synthetic_name(path: Column) -> Column:
    """The two folders above the parent joined to the name."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n >= 4, F.concat_ws("_", F.slice(parts, n - 3, F.lit(2)), F.element_at(parts, -1))).otherwise(F.element_at(parts, -1))


def pair_by_position(images: DataFrame, masks: DataFrame, by: tuple[str, ...], name: str = "name") -> DataFrame:
    """The k-th image of each dataset with its k-th mask, in order of name; the longer list's rest goes."""
    w = Window.partitionBy(*by).orderBy(name)
    left = images.select(*by, F.col(name).alias("image"), F.row_number().over(w).alias("rn"))
    right = masks.select(*by, F.col(name).alias("mask"), F.row_number().over(w).alias("rn"))
    return left.join(right, [*by, "rn"])


def stem_join(files: DataFrame, stems: DataFrame, anti: bool = False, path: str = "path", stem: str = "stem", automaton_bytes: int = 16 << 20) -> DataFrame:
    """Files whose path mentions one of the stems (semi), or none (anti); null paths mention none.

    Up to automaton_bytes of stems, an Aho-Corasick automaton of all of them goes to the tasks and reads each path
    once, whatever the number of stems: no shuffle.  Beyond, a substring test becomes a join: see `cut_join`."""
    key = stems.filter(F.length(stem) > 0).select(F.col(stem).alias("stem_")).distinct()
    size = key.agg(F.sum(F.octet_length("stem_") + 64)).first()[0] or 0
    if size > automaton_bytes:
        return cut_join(files, stems, anti, path, stem)
    shared = files.sparkSession.sparkContext.broadcast([r[0] for r in key.collect()])

    def mentions(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word in shared.value:
            machine.add_word(word, True)
        machine.make_automaton()
        for paths in series:
            yield pd.Series([isinstance(p, str) and bool(shared.value) and next(machine.iter(p), None) is not None for p in paths], paths.index, bool)

    hit = F.pandas_udf(mentions, "boolean")(F.col(path))
    return files.filter(~hit if anti else hit)


def cut_join(files: DataFrame, stems: DataFrame, anti: bool = False, path: str = "path", stem: str = "stem") -> DataFrame:
    """stem_join() for any number of stems.

    A substring test has no equi key, so the path's substrings of the stems' lengths (few: a path is
    short) are exploded and joined on the whole stem: a hash join on distinct keys, whatever the
    number of stems and however alike their beginnings."""
    sizes = [r[0] for r in stems.select(F.length(stem).alias("n")).filter("n > 0").distinct().collect()]  # at most the longest name
    key = stems.filter(F.length(stem) > 0).select(F.col(stem).alias("stem_")).distinct()
    own = files.select(F.col(path).alias("path_")).distinct()

    def cuts(n: int) -> Column:
        """All substrings of n characters."""
        every = F.transform(F.sequence(F.lit(1), F.length("path_") - n + 1), lambda i: F.substring("path_", i, F.lit(n)))
        return F.when(F.length("path_") >= n, every).otherwise(F.array().cast("array<string>"))

    pieces = F.array_distinct(F.flatten(F.array(*map(cuts, sorted(sizes))))) if sizes else F.array().cast("array<string>")
    hit = own.withColumn("stem_", F.explode(pieces)).join(key, "stem_", "left_semi").select("path_").distinct()
    return files.join(hit, files[path] == hit["path_"], "left_anti" if anti else "left_semi")


def name_differences(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """(name, side): names found on one side only."""
    left, right = a.select(name).distinct(), b.select(name).distinct()
    return left.join(right, name, "left_anti").withColumn("side", F.lit("a")).unionByName(right.join(left, name, "left_anti").withColumn("side", F.lit("b")))


def grouped(datasets: dict[str, DataFrame]) -> DataFrame:
    """One relation of several datasets, each under its name."""
    out = None
    for name, df in sorted(datasets.items()):
        one = df.withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no datasets")
    return out


def best_so_far(history: DataFrame, value: str = "value", by: str = "metric") -> DataFrame:
    """history(by, epoch, value) with the least value up to each epoch."""
    w = Window.partitionBy(by).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best", F.min(value).over(w))


def epochs_since_best(history: DataFrame, value: str = "value", by: str = "metric", least_gain: float = 0.0) -> DataFrame:
    """waited: epochs since the best value last fell, as an early stop counts them."""
    marked = best_so_far(history, value, by)
    before = F.lag("best").over(Window.partitionBy(by).orderBy("epoch"))
    fell = marked.withColumn("at_", F.when(before.isNull() | (F.col("best") < before - least_gain), F.col("epoch")))
    last = F.last("at_", ignorenulls=True).over(Window.partitionBy(by).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))
    return fell.withColumn("waited", F.col("epoch") - last).drop("at_")


def learning_rates(history: DataFrame, start: float, factor: float = 0.5, patience: int = 10, least_gain: float = 0.001, floor: float = 0.0, value: str = "value", by: str = "metric") -> DataFrame:
    """history(by, epoch, value) with the rate in force at each epoch: it falls by a factor once the value has
    not improved by least_gain for `patience` epochs, and the wait starts again.  Each step depends on the
    one before, so a training run (some hundred epochs) is a kernel's group."""

    def run(pdf):
        pdf = pdf.sort_values("epoch")
        best, waited, rate, out = float("inf"), 0, start, []
        for v in pdf[value]:
            out.append(rate)
            if v < best - least_gain:
                best, waited = v, 0
            else:
                waited += 1
                if waited >= patience:
                    rate, waited = max(rate * factor, floor), 0
        return pdf.assign(rate=out)[[by, "epoch", value, "rate"]].astype({value: float})

    kinds = {f.name: f.dataType.simpleString() for f in history.schema}
    return history.select(by, "epoch", value).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, epoch {kinds['epoch']}, {value} double, rate double")
