"""Source files written from the driver's nations, a Python and a TypeScript file for each; `#` is the nation's key, `@` the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .projection import table

PYTHON = '''import os
from .n@ import fn_@ as nxt


class Base#:
    """Doc of #."""

    @staticmethod
    def make(a: int, b="x") -> str:
        return os.environ["KEY_#"]

    def run(self):
        self.make(1)
        raise ValueError("no")


class Child#(Base#):
    pass


def fn_#(x):
    made = Base#()
    return nxt(x) + len(made.run())
'''

TYPESCRIPT = '''import { fn@ } from "./n@";
import type { Shape@ } from "./n@";
import fs from "fs";

/** Shape of #. */
export interface Shape# extends Shape@ {
  size: number;
}

export class Box# implements Shape# {
  constructor(private readonly size: number) {
    this.check(size);
  }

  check(n: number): void {
    if (n < 0) throw new RangeError("low");
  }
}

export function fn#(x: number): number {
  const box = new Box#(x);
  box.check(1);
  return fn@(x) + Number(process.env.KEY_#);
}

export const arrow# = (y: string) => fs.readFileSync(y);
'''


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, language): files that import each other in rings, by region."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    after = ((F.col("k") + 1) % 25).cast("string")
    written = lambda text: F.regexp_replace(F.regexp_replace(F.lit(text), "#", F.col("k").cast("string")), "@", after)
    python = nations.select(F.concat(F.lit("py/n"), "k", F.lit(".py")).alias("path"), F.regexp_replace(written(PYTHON.replace("@staticmethod", "~staticmethod")), "~", F.lit("@")).alias("content"), F.lit("python").alias("language"))
    script = nations.select(F.concat(F.lit("ts/n"), "k", F.lit(".ts")).alias("path"), written(TYPESCRIPT).alias("content"), F.lit("typescript").alias("language"))
    return python.unionByName(script)


def expected(rows: list[tuple], columns: str, folder: str) -> str:
    """SQL of rows for every nation, from rows in which `#` and `@` stand as in the sources."""
    def literal(v):
        return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    names = [c.strip() for c in columns.split(",")]
    filled = ", ".join(f"replace(replace({c}, '#', cast(n_nationkey as varchar)), '@', cast((n_nationkey + 1) % 25 as varchar)) as {c}" if any(isinstance(r[i], str) for r in rows) else c for i, c in enumerate(names))
    values = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    ending = {"py": ".py", "ts": ".ts"}[folder]
    return f"select '{folder}/n' || n_nationkey || '{ending}' as file_path, {filled} from nation, (values {values}) t({columns})"
