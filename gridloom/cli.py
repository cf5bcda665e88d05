"""Command line: compress, decompress and compare binary arrays.

    python -m gridloom.cli compress -t float -i data.bin -o out/data -v temp -d 3 -s "100 500 500" [--scheme prefix|multires]
    python -m gridloom.cli decompress -t float -i out/data -o back.bin -v temp
    python -m gridloom.cli compare -t float -i data.bin -o back.bin
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.operators.metrics import equality
from gridloom.operators.pyramid import compress
from gridloom.plans.domain import Domain, Layout
from gridloom.plans.types import elem
from gridloom.sources.binary import read_binary, read_values, write_binary
from gridloom.sources.container import read_container, write_container

#: Element types that the commands take.
TYPES = ("float", "double", "int16", "uint16", "int32", "uint32", "int64", "uint64")


def compress_file(spark: SparkSession, kind: str, path: str, prefix: str, variable: str, shape: list[int], scheme: str = "prefix") -> str:
    """Compresses a binary array (first dimension slowest) into ``prefix_variable.cmc``; gives the file's name."""
    layout = Layout.default(len(shape))
    grid = read_binary(spark, path, kind, variable, layout, Domain.default(layout, shape))
    return write_container(compress(grid, scheme), prefix)


def decompress_file(spark: SparkSession, kind: str, prefix: str, path: str, variable: str) -> None:
    """Restores the array of ``prefix_variable.cmc``; the type must be the file's."""
    container = read_container(spark, prefix, variable)
    if container.meta.elem != elem(kind):
        raise ValueError(f"the file holds {container.meta.elem.name}, not {elem(kind).name}")
    write_binary(container.decompress(), path)


def compare_files(spark: SparkSession, kind: str, first: str, second: str) -> dict:
    """Whether two arrays are equal, how many values differ and where the first does."""
    a = read_values(spark, first, kind).select("i", F.col("value").alias("initial"))
    b = read_values(spark, second, kind).select("i", F.col("value").alias("restored"))
    return equality(a.join(b, "i", "full")).first().asDict()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("compress", "decompress", "compare"))
    parser.add_argument("-t", required=True, help=f"element type: {', '.join(TYPES)}")
    parser.add_argument("-i", required=True, help="input: a binary array, or the prefix of a compressed file")
    parser.add_argument("-o", required=True, help="output prefix or file; for compare the second array")
    parser.add_argument("-v", default="var", help="name of the variable")
    parser.add_argument("-d", type=int, help="dimensionality")
    parser.add_argument("-s", help="shape, slowest dimension first, as '100 500 500'")
    parser.add_argument("--scheme", choices=("prefix", "multires"), default="prefix")
    a = parser.parse_args(args)
    if elem(a.t).name not in TYPES:
        parser.error(f"type {a.t} is not among {', '.join(TYPES)}")
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    if a.command == "compress":
        shape = [int(n) for n in (a.s or "").split()]
        if not shape or a.d not in (None, len(shape)):
            parser.error("the shape (-s) must have as many lengths as there are dimensions (-d)")
        name = compress_file(spark, a.t, a.i, a.o, a.v, shape, a.scheme)
        raw = elem(a.t).width // 8
        for n in shape:
            raw *= n
        size = os.path.getsize(name) if os.path.exists(name) else spark.read.format("binaryFile").load(name).agg(F.sum("length")).first()[0]
        print(f"{name}: {raw} bytes in {size} ({raw / size:.3f} to 1)")
        return 0
    if a.command == "decompress":
        decompress_file(spark, a.t, a.i, a.o, a.v)
        return 0
    found = compare_files(spark, a.t, a.i, a.o)
    print("equal" if found["equal"] else f"{found['mismatches']} values differ, the first at {found['first_mismatch']}")
    return 0 if found["equal"] else 1


if __name__ == "__main__":
    raise SystemExit(main())
