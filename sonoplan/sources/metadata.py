"""Metadata exports of any shape to the canonical record, and scans that read only what a check needs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoplan.functions import fields as f

MANIFEST = f.MANIFEST
EXTRA = ("channels", "file_format", "age_group", "transcript", "language_raw", "speaker_id_raw", "source_speaker_id", "source_reference", "target_reference", "source_split", "role", "metadata_locator", "rms", "almost_silent")
TYPES = {"duration": "double", "sample_rate": "int", "segment_start": "double", "segment_end": "double", "channels": "int", "rms": "double", "almost_silent": "boolean"}
#: Names under which each export may hold a field, the first known one counts.
COMMON = {
    "sample_id": ("sample_id", "id", "utterance_id"), "source_file": ("source_file", "file_name", "file", "path", "audio.path"), "speaker_id": ("speaker_id",), "language": ("language", "lang"), "gender": ("gender",),
    "duration": ("duration", "duration_seconds"), "sample_rate": ("sample_rate", "sampling_rate", "audio.sampling_rate"), "channels": ("channels", "num_channels"), "codec": ("codec",), "file_format": ("file_format",),
    "generator": ("generator",), "attack_type": ("attack_type",), "transcript": ("transcript", "text"), "age_group": ("age_group",), "processed_file": ("processed_file",), "source_split": ("split",),
}
SYNTHETIC = {
    "speaker_id": ("Target Speaker ID", "target_speaker", "target_speaker_id", "speaker_id"), "source_speaker_id": ("Source Speaker_ID", "source_speaker_id"), "source_reference": ("Source Reference Audio", "source_reference"),
    "target_reference": ("Target Reference Audio", "target_reference"), "generator": ("Generative Model", "generative_model", "generator", "synthesis_system"), "gender": ("Gender", "gender"), "transcript": ("TTS Transcript", "transcript"),
}
EXTERNAL = {"sample_id": ("sample_id", "notes.utterance_id"), "label": ("label",), "speaker_id": ("speaker_id", "notes.speaker_id"), "codec": ("codec", "notes.codec"), "attack_type": ("attack_id", "notes.attack_id"), "generator": ("generator", "notes.vocoder")}
#: Dataset: its fields, its fixed label, its split and role.
ADAPTERS: dict[str, tuple[dict, str | None, str, str]] = {"indicvoices": ({}, "bonafide", "unassigned", "train_dev"), "indicsynth": (SYNTHETIC, "spoof", "unassigned", "train_dev"), "asvspoof": (EXTERNAL, None, "external", "external_benchmark")}
MOST_BYTES, MOST_ROWS = 50 * 1024 * 1024, 100_000


def read_rows(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, most_rows: int = MOST_ROWS) -> DataFrame:
    """row_no, row (VARIANT) of a CSV, JSON-array or JSON-lines export, by suffix. CSV values stay text; blank lines are skipped; a row that is no object, or an export beyond the limits, is an error."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{path} has {size} bytes; at most {most_bytes} are read")
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        table = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
        table = table.toDF(*(c.removeprefix("﻿") for c in table.columns))
        rows = table.select(F.parse_json(F.to_json(F.struct(*(F.col(f"`{c}`") for c in table.columns)), {"ignoreNullFields": "false"})).alias("row"))
    elif kind in ("jsonl", "ndjson"):
        text = F.regexp_replace("value", "^﻿", "")
        rows = spark.read.text(path).where(F.trim(text) != "").select(F.parse_json(text).alias("row"))
    elif kind == "json":
        text = F.regexp_replace("value", "^﻿", "")
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(F.parse_json(text), "$", "array<variant>")).alias("row"))
    else:
        raise ValueError(f"{path} is none of csv, json, jsonl")
    is_object = F.schema_of_variant("row").startswith("OBJECT")
    checked = rows.select(F.when(is_object, F.col("row")).otherwise(F.raise_error(F.lit("a row is no object")).cast("variant")).alias("row"))
    if checked.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"{path} has more than {most_rows} rows")
    # an export is one bounded file: its order is that of its lines
    return checked.coalesce(1).select(F.monotonically_increasing_id().alias("row_no"), "row")


def lookup(row: Column, name: str) -> Column:
    """A literal key first, or a dotted way into nested objects."""
    literal = F.try_variant_get(row, f"$['{name}']", "string")
    return literal if "." not in name else F.coalesce(literal, F.try_variant_get(row, "$." + name, "string"))


def _flat(row: Column, name: str) -> Column:
    """The value under a name; an object or a list is an error."""
    held = F.try_variant_get(row, f"$['{name}']", "variant")
    held = held if "." not in name else F.coalesce(held, F.try_variant_get(row, "$." + name, "variant"))
    nested = F.schema_of_variant(held).rlike("^(OBJECT|ARRAY)")
    return F.when(nested, F.raise_error(F.lit(f"{name} is no scalar")).cast("string")).otherwise(lookup(row, name))


def first_known(row: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(f.scalar(_flat(row, n)) for n in names)) if names else F.lit(None).cast("string")


def adapt(rows: DataFrame, dataset: str, prefix: str = "", field_map: dict[str, str] | None = None, label_map: dict[str, str] | None = None, language: str | None = None, namespace: str | None = None) -> DataFrame:
    """The canonical 30 columns of rows (row_no, row). field_map puts one key in the place of a field's names; an unknown field, or a nested value in a field, is an error.

    language: of rows that name none. namespace: of speakers, in the place of the dataset."""
    special, label, split, role = ADAPTERS[dataset]
    names = {**COMMON, **special}
    for target, key in (field_map or {}).items():
        if target not in {*MANIFEST, *EXTRA}:
            raise ValueError(f"no canonical field {target}")
        names[target] = (key,)
    row = F.col("row")
    if dataset == "asvspoof":  # notes may be JSON in a text
        notes = F.try_variant_get(row, "$.notes", "string")
        row = F.coalesce(F.try_parse_json(F.regexp_replace(F.to_json(row), r'"notes":"(?:[^"\\]|\\.)*"', F.concat(F.lit('"notes":'), F.regexp_replace(F.coalesce(F.when(notes.startswith("{"), notes), F.lit("{}")), r"([\\$])", r"\\$1")))), row)
    got = {c: first_known(row, names.get(c, ())) for c in (*MANIFEST, *EXTRA)}
    out = dict(got)
    raw_label = first_known(row, names.get("label", ("label",)))
    mapped = reduce(lambda a, kv: F.when(raw_label == kv[0], F.lit(kv[1])).otherwise(a), (label_map or {}).items(), raw_label)
    out["label"] = F.lit(label) if label else F.when(mapped.isin("bonafide", "spoof"), mapped).otherwise(F.raise_error(F.concat(F.lit("illegal label: "), F.coalesce(mapped, F.lit("none")))).cast("string"))
    out["dataset"], out["split"], out["role"] = F.lit(dataset), F.lit(split), F.lit(role)
    out["language_raw"], out["speaker_id_raw"] = F.coalesce(got["language"], f.scalar(F.lit(language))), got["speaker_id"]
    out["language"], out["gender"] = f.language(out["language_raw"]), f.gender(got["gender"])
    out["speaker_id"], out["source_speaker_id"] = (f.namespaced(namespace or dataset, got[c]) for c in ("speaker_id", "source_speaker_id"))
    for c in ("duration", "sample_rate", "channels", "segment_start", "segment_end", "rms"):
        out[c] = f.number(got[c], integer=TYPES[c] == "int").cast(TYPES[c])
    out["almost_silent"] = F.lower(got["almost_silent"]).try_cast("boolean")
    out["file_format"] = f.file_format(got["file_format"], got["source_file"])
    out["metadata_locator"] = F.concat(F.lit(f"{prefix}#row="), F.col("row_no").cast("string"))
    out["sample_id"] = F.coalesce(got["sample_id"], f.made_id(F.lit(dataset), got["source_file"], out["metadata_locator"]))
    for c in ("generator", "attack_type"):
        out[c] = F.when(out["label"] != "bonafide", got[c])
    return rows.select(*(out[c].cast(TYPES.get(c, "string")).alias(c) for c in (*MANIFEST, *EXTRA)))


def load_inputs(spark: SparkSession, specs: dict[str, list[dict]]) -> DataFrame:
    """All exports of all datasets as one table; no input, or an id twice in a dataset, is an error."""
    parts = [adapt(read_rows(spark, s["path"]), dataset, s.get("prefix", s["path"]), s.get("field_map"), s.get("label_map"), s.get("language"), s.get("namespace")) for dataset, many in specs.items() for s in many]
    if not parts:
        raise ValueError("no input is named")
    out = reduce(DataFrame.unionByName, parts)
    if not out.groupBy("dataset", "sample_id").count().where("count > 1").isEmpty():
        raise ValueError("a sample_id stands twice in a dataset")
    return out


def read_required(spark: SparkSession, path: str, columns: list[str], most_rows: int | None = None) -> DataFrame:
    """The named columns of a Parquet table; a missing one, or more rows than the bound, is an error."""
    table = spark.read.parquet(path)
    gone = sorted(set(columns) - set(table.columns))
    if gone:
        raise ValueError(f"{path} lacks {gone}")
    if most_rows is not None and table.count() > most_rows:
        raise ValueError(f"{path} has more than {most_rows} rows")
    return table.select(*columns)


def read_strict_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON in which NaN, Infinity and broken rows are errors."""
    return spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", False).option("mode", "FAILFAST").json(path)


def read_sniffed(spark: SparkSession, path: str, needed: str = "original_file", separators: str = "|;,", languages: list[str] | None = None, inventory: DataFrame | None = None) -> DataFrame:
    """A delimited table whose separator is the one under which the header holds the needed column.

    languages: rows of another language are an error; inventory: (path) of the files there are, a row of another path is one."""
    table = _sniffed(spark, path, needed, separators)
    if languages is not None and not table.where(F.col("language").isNull() | ~F.col("language").isin(*languages)).isEmpty():
        raise ValueError(f"{path} has rows of other languages than {languages}")
    if inventory is not None and not table.join(inventory.select("path"), "path", "left_anti").isEmpty():
        raise ValueError(f"{path} names files that the inventory lacks")
    return table


def _sniffed(spark: SparkSession, path: str, needed: str, separators: str) -> DataFrame:
    head = (spark.read.text(path).first() or [""])[0].removeprefix("﻿")
    for s in separators:
        if needed in [x.strip() for x in head.split(s)]:
            return spark.read.option("header", True).option("sep", s).option("escape", '"').csv(path)
    raise ValueError(f"no separator gives a column {needed}")


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """Binary scan of all audio files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{wav,flac,ogg,mp3,opus,m4a,WAV,FLAC,OGG,MP3,OPUS,M4A}").load(folder)


def row_groups(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """file, row_group, first_row, n_rows, bytes (compressed, of the columns): from the footers only, one task per file."""
    files = spark.createDataFrame([(x,) for x in spark.read.parquet(path).inputFiles()], "file string")

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for b in batches:
            rows = []
            for file in b["file"]:
                with open_file(file) as handle:
                    meta, first = pq.ParquetFile(handle).metadata, 0
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    size = sum(group.column(c).total_compressed_size for c in range(group.num_columns) if not columns or group.column(c).path_in_schema.split(".")[0] in columns)
                    rows.append((file, g, first, group.num_rows, size))
                    first += group.num_rows
            yield pd.DataFrame(rows, columns=["file", "row_group", "first_row", "n_rows", "bytes"])

    return files.repartition(max(1, min(256, len(spark.read.parquet(path).inputFiles())))).mapInPandas(footers, "file string, row_group int, first_row bigint, n_rows bigint, bytes bigint")


def row_group_counts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """file, row_group, the columns, n_rows: rows of each combination in each row group. Only these columns are read, one task per file."""
    files = spark.createDataFrame([(x,) for x in spark.read.parquet(path).inputFiles()], "file string")
    kinds = {c.name: c.dataType.simpleString() for c in spark.read.parquet(path).schema}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for b in batches:
            for file in b["file"]:
                with open_file(file) as handle:
                    table = pq.ParquetFile(handle)
                    for g in range(table.num_row_groups):
                        held = table.read_row_group(g, columns=columns).group_by(columns).aggregate([([], "count_all")]).to_pandas()
                        yield held.rename(columns={"count_all": "n_rows"}).assign(file=file, row_group=g)[["file", "row_group", *columns, "n_rows"]]

    shape = ", ".join(["file string", "row_group int", *(f"`{c}` {kinds[c]}" for c in columns), "n_rows bigint"])
    return files.repartition(max(1, min(256, files.count()))).mapInPandas(count, shape)


def read_planned_groups(spark: SparkSession, plan: DataFrame, language: str, split: str, labels: tuple[str, ...] = ("bonafide", "spoof")) -> DataFrame:
    """unit and all columns of the rows of one language in the planned row groups (file, row_group, unit, n_rows), each read alone; the files need language, split, label and row_id.

    A row of the language with another split, an illegal label or no id, or a group with another number of such rows than planned, is an error."""
    first = plan.first()
    if first is None:
        raise ValueError("nothing is planned")
    kinds = spark.read.parquet(first["file"]).schema

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for b in batches:
            for file, group, unit, wanted in zip(b["file"], b["row_group"], b["unit"], b["n_rows"]):
                with open_file(file) as handle:
                    held = pq.ParquetFile(handle).read_row_group(int(group))
                rows = held.filter(pc.equal(held["language"], language)).to_pandas()
                if not (rows["split"].eq(split) & rows["label"].isin(labels) & rows["row_id"].notna()).all():
                    raise ValueError(f"a row of {unit} violates the split and label contract")
                if len(rows) != wanted:
                    raise ValueError(f"{unit} has {len(rows)} rows, {wanted} were planned")
                yield rows.assign(unit=unit)[["unit", *kinds.names]]

    shape = T.StructType([T.StructField("unit", T.StringType()), *kinds])
    return plan.select("file", "row_group", "unit", "n_rows").repartition(max(1, min(256, plan.count()))).mapInPandas(read, shape)


def covered(written: DataFrame, plan: DataFrame) -> DataFrame:
    """unit, planned, written of the units whose written rows aren't as many as planned; none if the sink is complete."""
    found = written.groupBy("unit").agg(F.count(F.lit(1)).alias("written"))
    both = plan.groupBy("unit").agg(F.sum("n_rows").alias("planned")).join(found, "unit", "full")
    return both.select("unit", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("written", F.lit(0)).alias("written")).where("planned <> written")


def by_ordinal(metadata: DataFrame, audio: DataFrame, number: str) -> DataFrame:
    """metadata with the audio of the same row number; of the audio only rows that are asked for. A number without audio is an error."""
    found = metadata.join(audio.withColumn("__there", F.lit(True)), number, "left")
    lost = F.raise_error(F.concat(F.lit("no audio of row "), F.col(number).cast("string"))).cast("boolean")
    return found.where(F.coalesce("__there", lost)).drop("__there")


def listing(files: DataFrame, pattern: str, most_bytes: int) -> DataFrame:
    """Files of an inventory (path, size) whose path has the pattern and whose size is within bounds, by path."""
    return files.where(F.col("path").rlike(pattern) & F.col("size").between(1, most_bytes)).orderBy("path")


def requested_subsets(wanted: list[str], offered: DataFrame) -> DataFrame:
    """requested, config: advertised names by case-insensitive match; null if there is none, an error if there are several. offered: config."""
    spark = offered.sparkSession
    names = spark.createDataFrame([(x,) for x in wanted], "requested string")
    many = F.when(F.count("config") > 1, F.raise_error(F.concat(F.lit("ambiguous: "), "requested")).cast("string")).otherwise(F.max("config"))
    return names.join(offered, F.lower("requested") == F.lower("config"), "left").groupBy("requested").agg(many.alias("config"))


def check_preview(names: list[str], truncated: DataFrame) -> None:
    """Refuses a preview that names a column twice, or of which a row (row_no, cells) has cells that were cut off."""
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"columns named twice: {doubled}")
    cut = truncated.where(F.size("cells") > 0).limit(3).collect()
    if cut:
        raise ValueError(f"cells were cut off in rows {[r['row_no'] for r in cut]}")


def feature_errors(features: DataFrame) -> DataFrame:
    """id of stored features whose digest doesn't match their bytes."""
    return features.where(F.sha2("feature", 256) != F.col("sha")).select("id")


def contiguous(index: DataFrame, column: str) -> DataFrame:
    """n, contiguous: whether the numbers are 0..n-1, each once."""
    return index.agg(F.count(F.lit(1)).alias("n"), F.coalesce((F.min(column) == 0) & (F.max(column) + 1 == F.count(F.lit(1))) & (F.countDistinct(column) == F.count(F.lit(1))), F.count(F.lit(1)) == 0).alias("contiguous"))


def source_probe(spark: SparkSession, cells: dict[tuple[str, str], str]) -> DataFrame:
    """source, language, status, error: what inspecting each source for each language gave; an error is kept with its cell."""
    rows = []
    for (source, lang), path in cells.items():
        try:
            spark.read.parquet(path).limit(1).count()
            rows.append((source, lang, "inspected", None))
        except Exception as e:  # noqa: BLE001
            rows.append((source, lang, "error", type(e).__name__))
    return spark.createDataFrame(rows, "source string, language string, status string, error string")


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False) + "\n"


def open_file(path: str):
    """A file of any file system that the path names, for reading in a task."""
    from urllib.parse import unquote

    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), unquote(path.removeprefix("file:")))
    return files.open_input_file(inner)


def archive_members(spark: SparkSession, path: str, suffix: str, done: DataFrame | None = None, sizes: dict[str, int] | None = None, wanted: list[str] | None = None) -> DataFrame:
    """archive, member, content of the files with this suffix in tar archives, compressed ones too; members that `done` (archive, member) holds are left out, and so are other kinds of members.

    One task per archive, which passes through it once, a member at a time, so that an archive may be larger than memory. sizes: bytes that each
    archive, by its name, must have. wanted: members that must all be there; others are left out."""

    found = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    if sizes is not None and {r["path"].rsplit("/", 1)[1]: r["length"] for r in found} != sizes:
        raise ValueError("archives aren't those that were pinned")
    asked = None if wanted is None else set(wanted)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tarfile

        for b in batches:
            for file in b["path"]:
                left = None if asked is None else set(asked)
                with open_file(file) as handle, tarfile.open(fileobj=handle, mode="r|*") as tar:
                    for m in tar:
                        if m.isfile() and m.name.lower().endswith(suffix) and (left is None or m.name in left):
                            if left is not None:
                                left.discard(m.name)
                            yield pd.DataFrame({"archive": [file], "member": [m.name], "content": [tar.extractfile(m).read()]})
                if left:
                    raise ValueError(f"{file} lacks {sorted(left)[:5]}")

    files = spark.createDataFrame([(r["path"],) for r in found], "path string")
    out = files.repartition(max(1, len(found))).mapInPandas(members, "archive string, member string, content binary")
    return out if done is None else out.join(done.select("archive", "member"), ["archive", "member"], "left_anti")


def enriched_plan(inventory: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Metadata with its inventory's columns; both must name the same keys, each once."""
    from sonoplan.operators.checks import bijection

    wrong = bijection(inventory, metadata, key).where("n > 0").collect()
    if wrong:
        raise ValueError(f"inventory and metadata differ: {[tuple(r) for r in wrong]}")
    return metadata.join(inventory, key)
