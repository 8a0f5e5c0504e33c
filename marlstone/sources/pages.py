"""A stream of a repository's answers, page by page: offsets are the tokens with which an answer says how to go on."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from marlstone.sources.archives import store_of

FIRST = "first"


class _TokenReader(SimpleDataSourceStreamReader):
    """Pages as they land: the first answer is ``first.xml``, the one for a token is ``<token>.xml``, special characters as ``_``."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def _answer(self, token: str) -> str | None:
        from pyarrow import fs

        store, base = store_of(self.path)
        file = f"{base}/{re.sub('[^A-Za-z0-9.-]', '_', token)}.xml"
        if store.get_file_info(file).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(file) as f:
            return f.read().decode()

    def initialOffset(self) -> dict:
        return {"token": FIRST, "page": 0}

    def _next(self, at: dict) -> tuple[tuple, dict] | None:
        """The answer for a token and the next token; None if it hasn't landed, or the last one was the end."""
        answer = self._answer(at["token"]) if at["token"] else None
        if answer is None:
            return None
        found = re.search(r"(?s)<resumptionToken[^>]*>(.*?)</resumptionToken>", answer)
        return (at["page"], at["token"], answer), {"token": found[1].strip() if found else "", "page": at["page"] + 1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The answers that have landed from the token on, ``most`` at most, and the token after them."""
        rows, at = [], start
        while len(rows) < self.most and (found := self._next(at)):
            rows.append(found[0])
            at = found[1]
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same answers again, after a failure."""
        at = start
        while at["page"] < end["page"]:
            row, at = self._next(at)
            yield row

    def commit(self, end: dict) -> None:
        pass


class TokenPages(DataSource):
    """``spark.readStream.format("token_pages").load(folder)``: (page, token, answer).

    An answer is asked for with the token of the one before, so pages are read one after the other, on the driver, ``pages`` of them (an option, 100) in a batch. A stream that is
    started again with its checkpoint goes on with the token where it stopped.
    """

    @classmethod
    def name(cls) -> str:
        return "token_pages"

    def schema(self) -> str:
        return "page int, token string, answer string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _TokenReader(self.options["path"], int(self.options.get("pages", "100")))
