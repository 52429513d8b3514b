"""Clients of the engine: streams of results, and calls that can be awaited."""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row

from .engine import Collection, Engine


def stream(results: DataFrame) -> Iterator[Row]:
    """The rows of a result one after the other, a partition at a time, the next one being fetched meanwhile."""
    return results.toLocalIterator(prefetchPartitions=True)


class _Awaited:
    """Calls the methods of an object in a thread; tables come as lists of rows, collections can be awaited in turn."""

    def __init__(self, own: Any):
        self._own = own

    def __getattr__(self, name: str) -> Any:
        method = getattr(self._own, name)
        if not callable(method):
            return method

        def call(*args: Any, **named: Any) -> Any:
            out = method(*args, **named)
            return out.collect() if isinstance(out, DataFrame) else out

        async def awaited(*args: Any, **named: Any) -> Any:
            out = await asyncio.to_thread(call, *args, **named)
            return AsyncCollection(out) if isinstance(out, Collection) else out

        return awaited


class AsyncCollection(_Awaited):
    """A collection whose methods are coroutines."""

    async def stream(self, results: DataFrame) -> AsyncIterator[Row]:
        """As :func:`stream`, without blocking the loop."""
        rows, end = stream(results), object()
        while (row := await asyncio.to_thread(next, rows, end)) is not end:
            yield row


class AsyncEngine(_Awaited):
    """An engine whose methods are coroutines."""

    def __init__(self, engine: Engine):
        super().__init__(engine)
