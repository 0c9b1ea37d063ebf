"""A paginated source: ``spark.read.format("pages")`` calls a fetcher with a growing offset until a page is empty.

Options: ``module`` and ``function`` name the fetcher, a callable (offset) -> list of row tuples; ``step`` (20), ``most`` (no
limit), ``pause`` (2 seconds, growing), ``schema`` by ``.schema()``. A page that fails is asked for three times; then the read
fails, so that a listing is never cut short unnoticed. Fetching is sequential by nature, so the source is one partition; downstream work is not.
"""

from __future__ import annotations

import importlib

from pyspark.sql.datasource import DataSource, DataSourceReader

from plenum.sources.providers import retrying


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "chamber string, title string, pdf_url string, session_date string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)


class PagesReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def read(self, partition):
        fetch = getattr(importlib.import_module(self.options["module"]), self.options["function"])
        fetch = retrying(fetch, pause=float(self.options.get("pause", 2.0)))
        step, most, offset, given = int(self.options.get("step", 20)), self.options.get("most"), 0, 0
        while True:
            rows = fetch(offset)
            if not rows:
                return
            for row in rows:
                if most is not None and given >= int(most):
                    return
                given += 1
                yield tuple(row)
            offset += step


def register(spark) -> None:
    spark.dataSource.register(PagesSource)
