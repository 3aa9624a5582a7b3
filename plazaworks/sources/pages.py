"""Pages of a site: from a table by default, from a fetcher where one is given; and places from a geocoder's answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plazaworks.functions import geo
from plazaworks.functions.text import address_line, first_filled
from plazaworks.operators.library import place_kind


class Geocoder(Protocol):
    """Answers a search with the map service's JSON; called in tasks with the fields of geocoder_query()."""

    def search(self, fields: dict[str, str]) -> str: ...


#: Characters of a search that are sent, and answers asked for.
MOST_QUERY, ANSWERS = 180, 5


def geocoder_query(text: str) -> dict[str, str] | None:
    """The fields of a search within the region; None for a blank text."""
    south, north, west, east = geo.REGION
    text = text.strip()[:MOST_QUERY]
    box = f"{west},{north},{east},{south}"
    return {"format": "jsonv2", "addressdetails": "1", "limit": str(ANSWERS), "countrycodes": "pl", "bounded": "1", "accept-language": "pl", "viewbox": box, "q": text} if text else None


def geocoded(searches: DataFrame, geocoder: Geocoder, text: str = "query") -> DataFrame:
    """searches with columns answer (JSON) and error: of a blank search, or what went wrong."""

    def ask(query: str | None) -> tuple[str | None, str | None]:
        fields = geocoder_query(query or "")
        if fields is None:
            return None, "empty query"
        try:
            return geocoder.search(fields), None
        except Exception as error:  # noqa: BLE001 - a search that fails is that row's
            return None, f"{type(error).__name__}: {error}"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [ask(x) for x in frame[text]]
            yield frame.assign(answer=[a for a, _ in answers], error=[e for _, e in answers])

    return searches.mapInPandas(work, searches.select("*", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error")).schema)


#: (status, body or None) of an address.
Fetcher = Callable[[str], tuple[int, str | None]]
TRIES, WAIT_S = 3, 0.4


def _asked(address: str, fetch: Fetcher, wait_s: float) -> tuple[int, str | None]:
    for k in range(1, TRIES + 1):
        status, body = fetch(address)
        if status != 429 and status < 500 or k == TRIES:
            break
        time.sleep(wait_s * k)
    return status, body


def page_source(fetch: Fetcher, wait_s: float = WAIT_S) -> type[DataSource]:
    """A data source "pages" to register: spark.read.format("pages").option("urls", addresses, one a line).load().

    Rows are (url, status, html); each task fetches up to option "together"
    (16) addresses, busy or failing servers again.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self._urls = [x.strip() for x in options.get("urls", "").splitlines() if x.strip()]
            self._together = int(options.get("together", "16"))

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(self._urls[k : k + self._together]) for k in range(0, len(self._urls), self._together)] or [InputPartition([])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for address in partition.value:
                yield (address, *_asked(address, fetch, wait_s))

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "pages"

        def schema(self) -> str:
            return "url string, status int, html string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Pages


def fetched(urls: DataFrame, fetch: Fetcher, url: str = "url", wait_s: float = WAIT_S) -> DataFrame:
    """urls with columns status and html; busy or failing servers (429, 5xx) are asked again, each time later."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [_asked(x, fetch, wait_s) for x in frame[url]]
            yield frame.assign(status=[s for s, _ in answers], html=[b for _, b in answers])

    return urls.mapInPandas(work, urls.select("*", F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("html")).schema)


_ADDRESS = ("house_number", "road", "pedestrian", "city", "town", "village", "municipality", "amenity", "shop", "tourism", "leisure")
PLACE = f"array<struct<lat:string,lon:string,category:string,type:string,name:string,display_name:string,address:struct<{','.join(f'{x}:string' for x in _ADDRESS)}>>>"


def places_found(answers: DataFrame, key: str, answer: str, most: int = 3) -> DataFrame:
    """(key, n, name, address, latitude, longitude, kind): up to most public places of each JSON answer, in its order.

    Private homes, roads, borders, places outside the region and those without
    a name or numbers are left out.
    """
    read = answers.select(key, F.posexplode(F.from_json(answer, PLACE)).alias("n", "p"))
    a = F.col("p.address")
    blank = lambda x: F.coalesce(x, F.lit(""))
    name = first_filled(F.col("p.name"), a["amenity"], a["shop"], a["tourism"], a["leisure"], F.split_part(blank(F.col("p.display_name")), F.lit(","), F.lit(1)))
    city = first_filled(a["city"], a["town"], a["village"], a["municipality"])
    found = read.select(
        key,
        "n",
        name.alias("name"),
        address_line(first_filled(a["road"], a["pedestrian"]), blank(a["house_number"]), city, blank(F.col("p.display_name"))).alias("address"),
        F.expr("try_cast(trim(p.lat) AS double)").alias("latitude"),
        F.expr("try_cast(trim(p.lon) AS double)").alias("longitude"),
        place_kind(blank(F.col("p.category")), blank(F.col("p.type"))).alias("kind"),
    )
    public = found.filter((F.col("kind") != "private") & (F.col("name") != "") & geo.in_region(F.col("latitude"), F.col("longitude")))
    firsts = public.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "name", "address", "latitude", "longitude", "kind"))), 1, most).alias("p"))
    return firsts.select(key, F.inline("p"))


def rejected_private(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, rejected_private): whether an answer has private places and no public one to show for it."""
    read = answers.select(key, F.explode_outer(F.from_json(answer, PLACE)).alias("p"))
    blank = lambda x: F.coalesce(x, F.lit(""))
    private = F.col("p").isNotNull() & (place_kind(blank(F.col("p.category")), blank(F.col("p.type"))) == "private")
    some = read.groupBy(key).agg(F.max(private.cast("int")).alias("_private"))
    shown = places_found(answers, key, answer).select(key).distinct().withColumn("_shown", F.lit(True))
    return some.join(shown, key, "left").select(key, ((F.col("_private") == 1) & F.col("_shown").isNull()).alias("rejected_private"))
