"""Readers of raw sources: strict CSV, JSON, JSON lines and Parquet tables, EDF and WFDB recordings."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_columns(found: list[str], expected: list[str]) -> None:
    """The columns must be exactly the expected ones, each once, in any order."""
    twice = sorted({c for c in found if found.count(c) > 1})
    if twice:
        raise ValueError(f"columns repeat: {twice}")
    if set(found) != set(expected):
        raise ValueError(f"columns missing: {sorted(set(expected) - set(found))}, not expected: {sorted(set(found) - set(expected))}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, drop_repeated_header: bool = False) -> DataFrame:
    """CSV in UTF-8 with a header of exactly the schema's columns; a ragged or mistyped row fails the read."""
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    head = spark.read.text(path).limit(1).head()
    names = next(csv.reader(io.StringIO(head[0].removeprefix("﻿")))) if head else []
    check_columns(names, want.names)
    raw = T.StructType([T.StructField(n, T.StringType() if drop_repeated_header else want[n].dataType) for n in names])
    rows = spark.read.csv(path, schema=raw, header=True, mode="FAILFAST", multiLine=True, enforceSchema=False, escape='"')
    if drop_repeated_header:
        same = F.lit(True)
        for n in names:
            same = same & F.col(n).eqNullSafe(F.lit(n))
        rows = rows.where(~same).select(*[F.col(n).cast(want[n].dataType).alias(n) for n in names])
    return rows.select(*want.names)


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    keys = [k for k, _ in pairs]
    if len(set(keys)) < len(keys):
        raise ValueError(f"keys repeat: {sorted({k for k in keys if keys.count(k) > 1})}")
    return dict(pairs)


def _json_rows(want: T.StructType, lines: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for where, text in zip(b["where"], b["value"]):
                try:
                    got = json.loads(text, object_pairs_hook=_no_repeats)
                except ValueError as e:
                    raise ValueError(f"{where}: {e}") from None
                if lines and not isinstance(got, dict) or not lines and not isinstance(got, list):
                    raise ValueError(f"{where}: not {'an object' if lines else 'a list'}")
                for row in [got] if lines else got:
                    if set(row) != set(want.names):
                        raise ValueError(f"{where}: keys {sorted(row)} are not {sorted(want.names)}")
                    out.append([row[n] for n in want.names])
            yield pd.DataFrame(out, columns=want.names)

    return run


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON list of objects per file; repeated keys and other keys than the schema's fail the read."""
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("where"), "value")
    return files.mapInPandas(_json_rows(want, False), want)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON object per line; an error names the line's text."""
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.concat(F.lit("line "), F.substring("value", 1, 40)).alias("where"), "value")
    return rows.mapInPandas(_json_rows(want, True), want)


def read_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a Parquet table; a missing or repeated one is an error, others aren't read."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing or len(set(columns)) < len(columns):
        raise ValueError(f"columns missing: {missing}, or asked for twice: {columns}")
    return df.select(*columns)


def parse_edf(content: bytes) -> tuple[dict, list[dict], np.ndarray]:
    """Header, signals, and the data records of an EDF file as int16 (records x samples)."""
    text = lambda a, n: content[a : a + n].decode("latin-1").strip()
    head = {"patient": text(8, 80), "recording": text(88, 80), "start": f"{text(168, 8)} {text(176, 8)}", "n_records": int(text(236, 8)), "record_s": float(text(244, 8)), "n_signals": int(text(252, 4))}
    n, at, fields = head["n_signals"], 256, {}
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("filter", 80), ("samples", 8), ("reserved", 32)):
        fields[name] = [text(at + i * width, width) for i in range(n)]
        at += n * width
    signals = []
    for i in range(n):
        s = {k: v[i] for k, v in fields.items()} | {k: float(fields[k][i]) for k in ("physical_min", "physical_max", "digital_min", "digital_max")}
        s["samples"] = int(s["samples"])
        if s["digital_max"] <= s["digital_min"]:
            raise ValueError(f"signal {s['label']!r}: empty digital range")
        signals.append(s)
    width = sum(s["samples"] for s in signals)
    data = np.frombuffer(content, "<i2", offset=at)
    whole = len(data) // width if width else 0
    return head, signals, data[: whole * width].reshape(whole, width)


def _edf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            head, signals, data = parse_edf(bytes(content))
            at, out = 0, []
            for s in signals:
                raw = data[:, at : at + s["samples"]].reshape(-1).astype(np.float64)
                at += s["samples"]
                if s["label"].startswith("EDF Annotations"):
                    continue
                gain = (s["physical_max"] - s["physical_min"]) / (s["digital_max"] - s["digital_min"])
                out.append((path, s["label"], s["unit"], s["samples"] / head["record_s"] if head["record_s"] else None, (s["physical_min"] + (raw - s["digital_min"]) * gain).astype(np.float32)))
            yield pd.DataFrame(out, columns=["path", "label", "unit", "rate_hz", "values"])


def read_edf(spark: SparkSession, path: str) -> DataFrame:
    """``path, label, unit, rate_hz, values``: the signals of EDF files in physical units; annotation channels are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_edf, "path string, label string, unit string, rate_hz double, values array<float>")


def parse_wfdb_header(text: str) -> tuple[dict, list[dict]]:
    """Record line and signal lines of a WFDB header (format 16)."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    name, n, rate, *rest = lines[0].split()
    head = {"name": name, "n_signals": int(n), "rate_hz": float(rate.split("/")[0].split("(")[0]), "n_samples": int(rest[0]) if rest else None}
    signals = []
    for x in lines[1 : 1 + head["n_signals"]]:
        file, fmt, scale, *more = x.split()
        if not fmt.startswith("16"):
            raise ValueError(f"format {fmt} isn't supported")
        gain_text, _, unit = scale.partition("/")
        gain, _, base = gain_text.partition("(")
        zero = int(more[1]) if len(more) > 1 else 0
        signals.append({"file": file, "gain": float(gain) or 200.0, "baseline": int(base.rstrip(")")) if base else zero, "unit": unit or "mV", "label": " ".join(more[5:])})
    return head, signals


def _wfdb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, header, content in zip(b["path"], b["header"], b["content"]):
            head, signals = parse_wfdb_header(header)
            raw = np.frombuffer(bytes(content), "<i2").reshape(-1, head["n_signals"])
            out = [(path, s["label"], s["unit"], head["rate_hz"], ((raw[:, i].astype(np.float64) - s["baseline"]) / s["gain"]).astype(np.float32)) for i, s in enumerate(signals)]
            yield pd.DataFrame(out, columns=["path", "label", "unit", "rate_hz", "values"])


def read_wfdb(spark: SparkSession, folder: str) -> DataFrame:
    """``path, label, unit, rate_hz, values`` of WFDB records (a .hea and a .dat of one name): (raw - baseline) / gain, where
    a gain of 0 means 200."""
    stem = lambda c, e: F.regexp_replace(c, r"\." + e + "$", "")
    read = lambda e: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{e}").load(folder)
    heads = read("hea").select(stem(F.col("path"), "hea").alias("path"), F.decode("content", "UTF-8").alias("header"))
    data = read("dat").select(stem(F.col("path"), "dat").alias("path"), "content")
    return heads.join(data, "path").mapInPandas(_wfdb, "path string, label string, unit string, rate_hz double, values array<float>")


def decode_png(content: bytes):
    """Pixels of an 8-bit PNG without interlacing as height x width x 3 or 4 (grey becomes RGB), turned as its EXIF tag says."""
    import struct
    import zlib

    import numpy as np

    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head, turn = 8, b"", None, 1
    while at < len(content):
        (n,) = struct.unpack(">I", content[at : at + 4])
        kind, data = content[at + 4 : at + 8], content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body += data
        elif kind == b"eXIf":
            order = "<" if data[:2] == b"II" else ">"
            first = struct.unpack(order + "I", data[4:8])[0]
            for k in range(struct.unpack(order + "H", data[first : first + 2])[0]):
                tag, _, _, value = struct.unpack(order + "HHIH", data[first + 2 + 12 * k : first + 12 + 12 * k])
                turn = value if tag == 0x0112 else turn
        at += 12 + n
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("only 8-bit grey, RGB and RGBA without interlacing can be read")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    before = np.zeros(width * channels, np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = (line + before) & 255
        elif kind in (1, 3, 4):
            for x in range(len(line)):
                a = line[x - channels] if x >= channels else 0
                b, c = before[x], before[x - channels] if x >= channels else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + (a if kind == 1 else (a + b) // 2 if kind == 3 else near)) & 255
        out[y], before = line, line
    pixels = out.reshape(height, width, channels)
    if channels < 3:  # grey, with or without transparency
        pixels = np.concatenate([np.repeat(pixels[..., :1], 3, axis=2), *([pixels[..., 1:]] if channels == 2 else [])], axis=2)
    if turn in (2, 4, 5, 7):
        pixels = pixels[:, ::-1]
    return np.ascontiguousarray(np.rot90(pixels, {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(turn, 0)))


def _images(batches):
    for b in batches:
        path, shape, values = [], [], []
        for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
            x = decode_png(c)
            path.append(p), shape.append(list(x.shape)), values.append(x.reshape(-1).astype("int16"))
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(shape, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int16()))], names=["path", "shape", "values"])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, shape, values``: PNG images as one step each, height x width x channels in row order."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_images, "path string, shape array<int>, values array<short>")
