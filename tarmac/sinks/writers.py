"""Sinks: label text files, COCO documents, detection dumps, manifests and tables for papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators.components import numbered


def label_line() -> Column:
    """'cls cx cy w h' with six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "cx", "cy", "w", "h")


def label_files(images: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    """key, content of one label file per image; an image without labels has an empty file, so that it counts as a negative."""
    per = labels.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(label_line())), "\n").alias("content"))
    return images.select(key).distinct().join(per, key, "left").select(key, F.coalesce("content", F.lit("")).alias("content"))


def write_label_files(files: DataFrame, folder: str, key: str = "stem") -> int:
    """Writes <folder>/<key>.txt from the executors, which must share the folder; the number written."""

    def run(batches):
        import os

        import pandas as pd

        n = 0
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            for k, content in zip(pdf[key], pdf["content"], strict=True):
                with open(os.path.join(folder, f"{k}.txt"), "w", encoding="utf-8", newline="\n") as f:
                    f.write(content + "\n" if content else "")
                n += 1
        yield pd.DataFrame({"n": [n]})

    return files.select(key, "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def tile_name(stem: Column, index: Column, n_tiles: Column) -> Column:
    """The stem for a whole image, else stem-tNN."""
    return F.when(n_tiles == 1, stem).otherwise(F.format_string("%s-t%02d", stem, index))


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """key, document: one COCO JSON text per key (a shard of the dataset that fits a document)."""
    part = lambda df, name: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*(c for c in df.columns if c != key)))).alias(name))
    cats = categories.agg(F.sort_array(F.collect_list(F.struct(*categories.columns))).alias("categories")).withColumn("_one", F.lit(1))
    j = part(images, "images").join(part(annotations, "annotations"), key, "left").withColumn("_one", F.lit(1)).join(cats, "_one")
    return j.select(key, F.to_json(F.struct("images", "annotations", "categories")).alias("document"))


def write_dump(dets: DataFrame, path: str) -> None:
    """JSON lines: confidences with 6 decimals, coordinates with 2."""
    r = lambda b: F.array(b["cls"].cast("double"), F.round(b["conf"], 6), *(F.round(b[k], 2) for k in ("x0", "y0", "x1", "y1")))
    dets.withColumn("dets", F.transform("dets", r)).write.mode("overwrite").json(path)


def data_yaml(root: str, names: dict[int, str], provenance: dict[str, str]) -> str:
    """A dataset description with its provenance as comments; a bounded text for the driver."""
    head = [f"# {k}: {v}" for k, v in sorted(provenance.items())]
    return "\n".join([*head, f"path: {root}", "train: images/train", "val: images/val", "names:", *(f"  {i}: {n}" for i, n in sorted(names.items()))]) + "\n"


def table_lines(rows: DataFrame, order: list[str], cells: list[Column]) -> DataFrame:
    """line_no, line: the body of a LaTeX table, one line per row; missing cells show as --. Lines are built where the rows are."""
    text = F.concat_ws(" & ", *(F.coalesce(F.replace(c.cast("string"), F.lit("_"), F.lit("\\_")), F.lit("--")) for c in cells))
    return numbered(rows.select(*order, F.concat(text, F.lit(r" \\")).alias("line")), order, "line_no").select("line_no", "line")


def latex_table(lines: list[str], columns: str, header: list[str], caption: str) -> str:
    """A LaTeX table around its body's lines."""
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{{columns}}}", r"\hline", " & ".join(header) + r" \\", r"\hline", *lines, r"\hline", r"\end{tabular}", r"\end{table}"]) + "\n"


def merged_reports(old: DataFrame, new: DataFrame) -> DataFrame:
    """report, stages: stages of the new rows replace those of the same name, all others stay. Both: report, stages (map of name to text)."""
    part = lambda df, k: df.select("report", F.posexplode(F.map_entries("stages")).alias("_", "e")).select("report", F.col("e.key").alias("stage"), F.struct(F.lit(k).alias("k"), F.col("e.value").alias("v")).alias("x"))
    one = part(old, 0).unionByName(part(new, 1)).groupBy("report", "stage").agg(F.max("x").alias("x"))
    return one.groupBy("report").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "x.v")))).alias("stages"))


def document(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """key, document: one JSON text per key from tables of few rows per key; each part is a list of its rows, sorted."""
    out = None
    for name, df in parts.items():
        rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(c for c in df.columns if c != key)))).alias(name))
        out = rows if out is None else out.join(rows, key, "full")
    return out.select(key, F.to_json(F.struct(*parts)).alias("document"))


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, such as the missed boxes."""
    rows.write.mode("overwrite").json(path)


def write_excluding(files: DataFrame, globs: list[str]) -> DataFrame:
    """Files (path) that no glob excludes; * stands for any run of characters, ? for one."""
    keep = F.lit(True)
    for g in globs:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c not in "_/" else c for c in g)
        keep = keep & ~F.col("path").rlike(f"^(.*/)?{pattern}$")
    return files.filter(keep)
