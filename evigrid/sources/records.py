"""Records of a service as a Spark data source: circle, box, order, limit and Spark's own filters go to where the records are.

``records`` reads either a folder of JSON lines (any file system that Arrow knows; each file in byte ranges, one task each), or a
service over HTTP that takes $where, $order, $limit and $offset (one task a page). Comparisons of a column with a value, IN, IS NOT NULL
and prefixes are taken over by the source; all others are left to Spark.

Edge cases: fields that a record lacks, or whose value does not fit their type, are null; null fulfils no filter; lines that are no JSON
object are left out; an empty folder has no rows; records without both coordinates lie in no circle and no box.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from ..functions.geo import EARTH_RADIUS_M

SPLIT_BYTES = 32 << 20
PAGE = 1000
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_TESTS = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: a in b, "starts": lambda a, b: a.startswith(b), "known": lambda a, b: True}
_KINDS = {"bigint": int, "int": int, "double": float, "float": float, "string": str, "boolean": bool}


@dataclass
class Slice(InputPartition):
    """Bytes of a file whose lines begin in them, or a page of a service."""

    path: str
    begin: int
    end: int


def distance_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(a))


def _typed(value, kind: type):
    """A value as its column's type; None where it does not fit."""
    if value is None or isinstance(value, (dict, list)):
        return json.dumps(value) if kind is str and value is not None else None
    if kind is bool:
        return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).lower())
    if kind is str:
        return value if isinstance(value, str) else json.dumps(value)
    try:
        number = float(value)
        return number if kind is float else int(value) if number == int(number) else None
    except (TypeError, ValueError, OverflowError):
        return None


class RecordsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.kinds = {f.name: _KINDS[f.dataType.simpleString()] for f in schema.fields}
        self.url = options["url"]
        self.places = options.get("lat", "lat"), options.get("lon", "lon")
        self.circle = json.loads(options["circle"]) if options.get("circle") else None
        self.box = json.loads(options["box"]) if options.get("box") else None
        self.order, self.descending = (options.get("order") or ""), options.get("descending") == "true"
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.split = int(options.get("split_bytes") or SPLIT_BYTES)
        self.page = int(options.get("page") or PAGE)
        self.pushed: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            of = getattr(f, "attribute", ())
            name = of[0] if len(of) == 1 and of[0] in self.kinds else None
            if name and type(f) in _SIGNS and isinstance(f.value, (int, float, str, bool)):
                self.pushed.append((name, _SIGNS[type(f)], f.value))
            elif name and isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
                self.pushed.append((name, "in", list(f.value)))
            elif name and isinstance(f, IsNotNull):
                self.pushed.append((name, "known", None))
            elif name and isinstance(f, StringStartsWith):
                self.pushed.append((name, "starts", f.value))
            else:
                yield f

    def where(self) -> str:
        """What a service is asked for."""
        say = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
        parts = []
        if self.circle:
            parts.append(f"within_circle({self.places[0]}, {self.places[1]}, {', '.join(map(repr, self.circle))})")
        if self.box:
            parts.append(f"within_box({self.places[0]}, {self.places[1]}, {', '.join(map(repr, self.box))})")
        for name, sign, value in self.pushed:
            parts.append({"in": lambda: f"{name} in ({', '.join(map(say, value))})", "known": lambda: f"{name} IS NOT NULL", "starts": lambda: f"starts_with({name}, {say(value)})"}.get(sign, lambda: f"{name} {sign} {say(value)}")())
        return " AND ".join(parts)

    def _ask(self, offset: int, limit: int) -> list[dict]:
        asked = {"$where": self.where(), "$order": self.order + (" DESC" if self.descending else ""), "$limit": limit, "$offset": offset}
        with urlopen(f"{self.url}?{urlencode({k: v for k, v in asked.items() if v != ''})}", timeout=30) as answer:
            return json.load(answer)

    def partitions(self) -> list[Slice]:
        if self.url.startswith("http"):
            if self.limit is None:
                # The service says how many there are.
                with urlopen(f"{self.url}?{urlencode({'$select': 'count(*)', '$where': self.where()})}", timeout=30) as answer:
                    total = int(next(iter(json.load(answer)[0].values())))
            else:
                total = self.limit
            return [Slice(self.url, i, min(total, i + self.page)) for i in range(0, total, self.page)] or [Slice("", 0, 0)]
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.url)
        files = sorted((f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.base_name.endswith((".json", ".jsonl"))), key=lambda f: f.path)
        return [Slice(f.path, i, min(f.size, i + self.split)) for f in files for i in range(0, f.size, self.split)] or [Slice("", 0, 0)]

    def _lines(self, part: Slice) -> Iterator[dict]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.url)
        with system.open_input_file(part.path) as file:
            file.seek(max(0, part.begin - 1))
            if part.begin:
                _skip_line(file)
            while file.tell() < part.end:
                line = _line(file)
                try:
                    found = json.loads(line)
                except ValueError:
                    continue
                if isinstance(found, dict):
                    yield found

    def _fits(self, row: dict) -> bool:
        if self.circle or self.box:
            lat, lon = (_typed(row.get(c), float) for c in self.places)
            if lat is None or lon is None:
                return False
            if self.circle and not distance_m(self.circle[0], self.circle[1], lat, lon) <= self.circle[2]:
                return False
            if self.box and not (self.box[0] <= lat <= self.box[2] and self.box[1] <= lon <= self.box[3]):
                return False
        for name, sign, value in self.pushed:
            own = _typed(row.get(name), self.kinds[name])
            if own is None or not _TESTS[sign](own, value):
                return False
        return True

    def read(self, part: Slice) -> Iterator[tuple]:
        if part.begin == part.end:
            return
        remote = self.url.startswith("http")
        rows = self._ask(part.begin, part.end - part.begin) if remote else filter(self._fits, self._lines(part))
        found = (tuple(_typed(r.get(n), k) for n, k in self.kinds.items()) for r in rows)
        if self.limit is not None and not remote:
            # The first rows of this part; those of all parts are ordered again.
            at = list(self.kinds).index(self.order)
            found = heapq.nsmallest(self.limit, found, key=lambda r: (_Place(r[at], self.descending), *map(_Place, r)))
        yield from found


class _Place:
    """A value's place in an order as Spark has it: nulls before all others, or last if it is descending."""

    def __init__(self, value, descending: bool = False):
        self.value, self.descending = value, descending

    def __lt__(self, other: "_Place") -> bool:
        a, b = (other.value, self.value) if self.descending else (self.value, other.value)
        return b is not None and (a is None or a < b)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Place) and self.value == other.value


def _line(file, step: int = 1 << 16) -> bytes:
    """The next line of a file that can be sought in."""
    out, at = [], file.tell()
    while True:
        got = file.read(step)
        end = got.find(b"\n")
        out.append(got if end < 0 else got[: end + 1])
        at += len(out[-1])
        if end >= 0 or len(got) < step:
            file.seek(at)
            return b"".join(out)


def _skip_line(file) -> None:
    _line(file)


class RecordsSource(DataSource):
    """Options: url, lat, lon (names of the coordinates), circle, box, order, descending, limit, split_bytes, page."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        raise ValueError("name the fields to read by .schema(...)")

    def reader(self, schema: StructType) -> RecordsReader:
        return RecordsReader(schema, dict(self.options))


def records(spark: SparkSession, url: str, fields: str, circle: tuple | None = None, box: tuple | None = None, order: str | None = None, descending: bool = False, limit: int | None = None, **options) -> DataFrame:
    """The records of a folder (file, hdfs, s3 ...) or service (http): `fields` is a DDL schema; circle (lat, lon, metres), box (min_lat,
    min_lon, max_lat, max_lon), order (a field; ties go by all fields) and limit go to the source. Filters on the result go there too."""
    if limit is not None and not order:
        raise ValueError("a limit needs an order, or its rows would depend on the partitions")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordsSource)
    given = {"url": url, "circle": circle and json.dumps(list(circle)), "box": box and json.dumps(list(box)), "order": order, "descending": str(descending).lower(), "limit": limit, **options}
    rows = spark.read.format("records").schema(fields).options(**{k: v for k, v in given.items() if v is not None}).load()
    return rows if limit is None else rows.orderBy(F.desc(order) if descending else F.asc(order), *rows.columns).limit(limit)
