"""Value sets and code systems: expansion, membership, lookup; on the driver for rules, as a frame for joins."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from enum import Enum
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Code:
    system: str
    code: str
    display: str = ""
    active: bool = True


def plain_url(url: str) -> str:
    """A canonical URL without |version."""
    return url.split("|", 1)[0]


class Terminology:
    def __init__(self):
        self.systems: dict[str, dict[str, Code]] = {}
        self.sets: dict[str, dict[tuple[str, str], Code]] = {}

    # loading: code systems first, as value sets are made from them

    def load(self, *resources: dict) -> None:
        flat = [r for x in resources for r in ([e.get("resource") or {} for e in x.get("entry") or []] if x.get("resourceType") == "Bundle" else [x])]
        for r in flat:
            if r.get("resourceType") == "CodeSystem" and r.get("url") and r.get("content") in ("complete", "fragment"):
                self.systems[r["url"]] = {c.code: c for c in self._flatten(r.get("concept") or [], r["url"])}
        for r in flat:
            if r.get("resourceType") == "ValueSet" and r.get("url"):
                self.sets[r["url"]] = self._expand(r)

    def load_file(self, path: str) -> None:
        self.load(json.loads(Path(path).read_text()))

    def load_folder(self, path: str) -> None:
        found = []
        for file in sorted(Path(path).rglob("*.json")):
            try:
                found.append(json.loads(file.read_text()))
            except (ValueError, OSError):
                continue
        self.load(*found)

    def save(self, path: str) -> int:
        """All value sets' codes as one table file, a line of JSON each, which load_table reads; how many."""
        rows = [[url, c.system, c.code, c.display, c.active] for url, codes in sorted(self.sets.items()) for _, c in sorted(codes.items())]
        Path(path).write_text("".join(json.dumps(r) + "\n" for r in rows))
        return len(rows)

    def load_table(self, path: str) -> None:
        for line in Path(path).read_text().splitlines():
            url, *code = json.loads(line)
            c = Code(*code)
            self.sets.setdefault(url, {})[c.system, c.code] = c

    def _flatten(self, concepts: list, system: str):
        for c in concepts:
            if c.get("code"):
                yield Code(system, c["code"], c.get("display", ""))
            yield from self._flatten(c.get("concept") or [], system)

    def _expand(self, r: dict) -> dict[tuple[str, str], Code]:
        out: dict[tuple[str, str], Code] = {}
        expansion = (r.get("expansion") or {}).get("contains") or []
        if expansion:
            for c in expansion:
                if c.get("code"):
                    out[c.get("system", ""), c["code"]] = Code(c.get("system", ""), c["code"], c.get("display", ""), not c.get("inactive"))
            return out
        for include in (r.get("compose") or {}).get("include") or []:
            system = include.get("system")
            if not system:
                continue
            if include.get("concept"):
                codes = [Code(system, c["code"], c.get("display", "")) for c in include["concept"] if c.get("code")]
            else:
                codes = self._filtered(list(self.systems.get(system, {}).values()), include.get("filter") or [])
            out |= {(system, c.code): c for c in codes}
        return out

    @staticmethod
    def _filtered(codes: list[Code], filters: list[dict]) -> list[Code]:
        for f in filters:
            if f.get("property") != "code":
                continue
            wanted = f.get("value", "")
            if f.get("op") == "=":
                codes = [c for c in codes if c.code == wanted]
            elif f.get("op") == "in":
                codes = [c for c in codes if c.code in {x.strip() for x in wanted.split(",")}]
        return codes

    # use

    def has_set(self, url: str) -> bool:
        return plain_url(url) in self.sets

    def has_system(self, url: str) -> bool:
        return url in self.systems

    def expand(self, url: str) -> list[Code]:
        return list(self.sets.get(plain_url(url), {}).values())

    def enumeration(self, url: str, name: str) -> type[Enum]:
        """A value set's codes as an enumeration; a member is named by its code, in capitals."""
        return Enum(name, {re.sub(r"\W", "_", c.code).upper().lstrip("_") or "_": c.code for c in self.expand(url)})

    def lookup(self, system: str, code: str) -> Code | None:
        return self.systems.get(system, {}).get(code)

    def contains(self, url: str, system: str, code: str) -> bool | None:
        """None for an unknown value set; without a system any system's code counts."""
        found = self.sets.get(plain_url(url))
        if found is None:
            return None
        return (system, code) in found if system else any(c == code for _, c in found)

    def stats(self) -> dict[str, int]:
        return {"value_sets": len(self.sets), "code_systems": len(self.systems), "codes": sum(map(len, self.sets.values()))}

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row for each code of each value set."""
        rows = [(url, c.system, c.code, c.display, c.active) for url, codes in self.sets.items() for c in codes.values()]
        return spark.createDataFrame(rows, "value_set string, system string, code string, display string, active boolean")


def not_in_set(df: DataFrame, code: Column, codes: DataFrame, value_set: str) -> DataFrame:
    """The rows of df whose code is not in the value set: an anti-join on the code."""
    known = codes.where(F.col("value_set") == plain_url(value_set)).select(F.col("code").alias("_known")).distinct()
    return df.where(code.isNotNull()).join(known, code == F.col("_known"), "left_anti")
