"""Writing a provider over HTTP: which answers are tried again, which end the call, and which end the run.

`send(payload)` is the transport: it gives (status, body) or raises TimeoutError or ConnectionError. Nothing here opens a connection itself."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd

# Seconds between tries, what is tried again, what no further call can cure, and options that a service may not know.
WAITS, BUSY, REJECTED, OPTIONS = (2, 5, 15), (429, 500, 502, 503, 504), (401, 402, 403), ("reasoning",)
#: How an error row says that the whole run has to stop.
FATAL = "fatal: "

Send = Callable[[dict], tuple[int, dict]]


class FatalError(RuntimeError):
    """The service rejects every call: key, credit or right is missing."""


def ask(send: Send, payload: dict, sleep: Callable[[float], None] = time.sleep, waits: tuple = WAITS) -> dict:
    """The body of a good answer. Timeouts and busy answers are tried again after each wait; an option that the service does not know is dropped."""
    left = list(waits)

    def wait() -> bool:
        if left:
            sleep(left.pop(0))
            return True
        return False

    while True:
        try:
            status, body = send(payload)
        except (TimeoutError, ConnectionError):
            if wait():
                continue
            raise
        unknown = [o for o in OPTIONS if o in payload and o in str(body).lower()] if status == 400 else []
        if unknown:
            payload = {k: v for k, v in payload.items() if k not in unknown}
        elif status not in BUSY or not wait():
            break
    if status in REJECTED:
        raise FatalError(f"HTTP {status}: {str(body)[:300]}")
    if status >= 400 or body.get("error"):
        raise RuntimeError(f"HTTP {status}: {str(body.get('error') or body)[:300]}")
    if not (body.get("text") or "").strip():
        raise RuntimeError(f"no text came back ({body.get('finish_reason')})")
    return body


def http_provider(send: Send, threads: int = 1, sleep: Callable[[float], None] = time.sleep, **payload) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A provider whose calls go through `ask`; an error is a row, and one that ends the run says so. After such a one the rest of a batch is not sent."""

    def one(row, stopped: list) -> tuple:
        head = (row.id, row.attempt, row.prompt, row.model)
        if stopped:
            return (*head, None, stopped[0], 0, 0)
        try:
            body = ask(send, {"model": row.model, "prompt": row.prompt, **payload}, sleep)
            return (*head, body["text"].strip(), None, int(body.get("input_tokens") or 0), int(body.get("output_tokens") or 0))
        except FatalError as error:
            stopped.append(FATAL + str(error))
            return (*head, None, stopped[0], 0, 0)
        except Exception as error:
            return (*head, None, f"{type(error).__name__}: {error}", 0, 0)

    def provide(pdf: pd.DataFrame) -> pd.DataFrame:
        stopped: list[str] = []
        with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
            rows = list(pool.map(lambda r: one(r, stopped), pdf.itertuples(index=False)))
        return pd.DataFrame(rows, columns=["id", "attempt", "prompt", "model", "reply", "error", "input_tokens", "output_tokens"])

    return provide
