"""Sound files to frames of a codec and back, as a program: ``python -m framewright --encode c1 -i in.wav -o out.aea``.

The input is a file or a folder of files, which are encoded side by side; the output is a
folder unless its name has a known extension and the input is one file. Spark's settings
come from the environment (``spark-submit``); alone, it runs on all local cores.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import tables as T
from framewright.operators import gain, packing
from framewright.operators.framing import double_mono
from framewright.plans import codec, codec2, kernels
from framewright.sources import containers as B

SUFFIX = {"aea": "aea", "oma": "oma", "riff": "wav", "rm": "rm", "raw": "raw"}


class Refused(ValueError):
    """Options or inputs that the program cannot serve."""


def arguments(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("framewright", description=__doc__.split("\n")[0])
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("-e", "--encode", nargs="?", const="c1", choices=("c1", "c2"), help="encode, by the first codec if none is named")
    what.add_argument("-d", "--decode", action="store_true", help="decode AEA files of the first codec into WAV files")
    p.add_argument("-i", dest="source", required=True)
    p.add_argument("-o", dest="target", required=True)
    p.add_argument("--bitrate", type=int, help="kbit/s of the second codec, 32 to 384")
    p.add_argument("--container", choices=sorted(SUFFIX))
    p.add_argument("--advanced", help="key=value,key=value")
    p.add_argument("--log", help="folder for the decisions on gain points, as JSON")
    return p.parse_args(args)


def frame_bytes(bitrate: int | None) -> int:
    """Bytes of a frame of two channels at so many kbit/s; joint stereo is not written."""
    if bitrate is not None and not 32 <= bitrate <= 384:
        raise Refused(f"bitrate {bitrate} is not in 32 to 384")
    wanted = bitrate * 1024 if bitrate else 132300
    _, size, joint = next((c for c in T.C2_CONTAINERS if c[0] >= wanted), T.C2_CONTAINERS[-1])
    if joint:
        raise Refused(f"bitrate {bitrate} asks for joint stereo, which is not written")
    return size


def container(codec_name: str, extension: str, named: str | None) -> str:
    """The named container, else the one that the extension stands for."""
    kind = named or ("raw" if extension in ("raw", "dat") else "aea" if codec_name == "c1" else {"wav": "riff", "at3": "riff", "rm": "rm"}.get(extension, "oma"))
    if kind not in B.LEGAL[codec_name]:
        raise Refused(f"{kind} cannot hold {codec_name}")
    return kind


def encoded(signal: DataFrame, codec_name: str, kind: str, size: int, channels: int, title: str = "") -> DataFrame:
    """(track, content) of a signal of ``channels`` channels. Frames of the second codec hold two channels; mono counts twice."""
    if codec_name == "c1":
        frames = codec.encode(signal)
        return B.assemble(frames, (lambda f: B.aea_bytes(f, channels, title)) if kind == "aea" else lambda f: B.raw_bytes(f, 212))
    units = codec2.encode(signal, size // 2)
    by_frame = units.groupBy("track", "frame").agg(F.array_sort(F.collect_list(F.struct("ch", "payload"))).alias("u"))
    payload = F.when(F.size("u") == 1, double_mono(F.get("u", 0)["payload"])).otherwise(F.concat(F.get("u", 0)["payload"], F.get("u", 1)["payload"]))
    build = {"oma": lambda f: B.oma_bytes(f, "c2"), "riff": lambda f: B.riff_bytes(f, 2), "rm": lambda f: B.rm_bytes(f, 2), "raw": lambda f: B.raw_bytes(f, size)}[kind]
    return B.assemble(by_frame.select("track", F.lit(0).alias("ch"), "frame", payload.alias("payload")), build)


def sound_files(signal: DataFrame) -> DataFrame:
    """(track, content) of a signal (track, ch, i, x) as WAV files; a file is one value, so a track must fit in a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((int(pdf["i"].max()) + 1, int(pdf["ch"].max()) + 1))
        x[pdf["i"].to_numpy(), pdf["ch"].to_numpy()] = pdf["x"].to_numpy()
        return pd.DataFrame({"track": [pdf["track"].iloc[0]], "content": [B.wav_bytes(x)]})

    return signal.groupBy("track").applyInPandas(run, "track string, content binary")


def _sound(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The signal at ``path`` and its channels; files that cannot be read, or differ in their channels, are refused."""
    rows = B.read_samples(spark, path)
    found = rows.groupBy("path").agg(F.max("error").alias("error"), (F.max("ch") + 1).alias("channels"))
    kinds = found.groupBy("channels", "error").agg(F.min("path").alias("path")).limit(20).collect()  # a row a kind, not a file
    for r in kinds:
        if r.error:
            raise Refused(f"{r.path}: {r.error}")
    channels = sorted(r.channels for r in kinds)
    if len(channels) != 1 or channels[0] > 2:
        raise Refused("no input" if not channels else "the files must all be mono or all stereo")
    return rows.select("track", "ch", "i", "x"), channels[0]


def store(files: DataFrame, target: str, suffix: str) -> None:
    """One file where ``target`` names one, else a folder with a file a track."""
    if os.path.splitext(target)[1].lower().lstrip(".") not in (*B.EXTENSIONS, "dat"):
        files.sparkSession.dataSource.register(B.SoundFiles)
        files.write.format("sound").option("extension", suffix).mode("append").save(target)
        return
    rows = files.limit(2).collect()
    if len(rows) != 1:
        raise Refused("several tracks need a folder as output")
    held = f"{target}.{uuid.uuid4().hex}.part"
    with open(held, "wb") as f:
        f.write(rows[0].content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(held, target)


def perform(spark: SparkSession, options: argparse.Namespace) -> None:
    """Does what the options say, or raises Refused before anything is written."""
    if options.advanced:
        fault = spark.range(1).select(packing.advanced_options(F.lit(options.advanced))["error"].alias("e")).first().e
        raise Refused(f"--advanced: {fault or 'there is no encoder of the third codec yet'}")
    if options.decode:
        if options.container:
            raise Refused("--container is for encoding")
        rows = B.read_frames(spark, options.source, "aea")
        bad = rows.where("error IS NOT NULL").select("path", "error").first()
        if bad:
            raise Refused(f"{bad.path}: {bad.error}")
        channels = F.regexp_extract("info", r"channels=(\d)", 1).cast("int")
        frames = rows.select("track", F.pmod("n", channels).cast("int").alias("ch"), F.floor(F.col("n") / channels).alias("frame"), "payload")
        store(sound_files(codec.decode(frames)), options.target, "wav")
        return
    if options.bitrate and options.encode != "c2":
        raise Refused("--bitrate is for the second codec")
    if options.log and options.encode != "c2":
        raise Refused("--log is for the second codec")
    size = frame_bytes(options.bitrate)
    kind = container(options.encode, os.path.splitext(options.target)[1].lower().lstrip("."), options.container)
    signal, channels = _sound(spark, options.source)
    title = re.sub(r"\.[^.]*$", "", os.path.basename(options.source))
    store(encoded(signal, options.encode, kind, size, channels, title), options.target, SUFFIX[kind])
    if options.log:
        gain.decisions(kernels.profiles(signal), F.lit(0)).write.mode("overwrite").json(options.log)


def main(args: list[str] | None = None) -> int:
    options = arguments(sys.argv[1:] if args is None else args)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("framewright").getOrCreate()
    try:
        perform(spark, options)
    except Refused as e:
        print(e, file=sys.stderr)
        return 1
    return 0
