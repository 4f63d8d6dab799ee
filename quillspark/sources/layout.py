"""Where things stand: a user's folder has datasets, a dataset has stages, a stage has a folder for each document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import path_parts

#: The stages of a dataset and the files of a document in each.
FILES = {
    "documents": (), "parse": ("full.md",), "data_clean": ("document.md", "doi.json", "references.json", "label_structure.json", "label_structure_cleaned.json", "equation.json", "figures.json", "main_letter.json", "citation.json", "citation_by_article.json"),
    "graph": ("citation_graph.gexf", "01_tree.json", "02_raw.json", "03_final.json"), "citation-features": ("edge_features.parquet", "node_features.parquet", "report.json"), "vector": (), "logs": (),
}


def folder(user: str, dataset: str, stage: str, root: str = "users") -> str:
    """The folder of a stage of a dataset."""
    if stage not in FILES:
        raise ValueError(f"unknown stage {stage!r}; known: {', '.join(FILES)}")
    if not user or not dataset or "/" in user + dataset:
        raise ValueError("a user and a dataset have names without slashes")
    return f"{root}/{user}/{dataset}/{stage}"


def path(user: str, dataset: str, stage: str, name: str, file_id: str | None = None, root: str = "users") -> str:
    """The path of a file of a stage, in a document's folder if file_id is given."""
    at = folder(user, dataset, stage, root)
    if FILES[stage] and name not in FILES[stage]:
        raise ValueError(f"{stage} has no file {name!r}")
    return f"{at}/{file_id}/{name}" if file_id else f"{at}/{name}"


def registry(user: str, dataset: str, root: str = "users") -> str:
    return f"{root}/{user}/{dataset}/documents.json"


def column(user: Column, dataset: Column, stage: str, name: str, file_id: Column, root: str = "users") -> Column:
    """The same of columns."""
    if stage not in FILES or FILES[stage] and name not in FILES[stage]:
        raise ValueError(f"{stage} has no file {name!r}")
    return F.concat_ws("/", F.lit(root), user, dataset, F.lit(stage), file_id, F.lit(name))


def owner(file_path: Column) -> Column:
    """(user, dataset) of a document's path; an error for a path of another shape."""
    found = path_parts(file_path)
    return F.when(file_path.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("no document's path: "), file_path)).cast("struct<user:string,dataset:string>")).otherwise(found)
