"""Live services behind the tables of requests and answers.

A ``Service`` says how one question is sent; ``transport``, ``model`` and ``images`` turn it into
the functions that the walks, the model's steps and the covers take. Questions are sent by the
executors, in ``lanes`` tasks with a pause after each, so a service's rate does not depend on the
cluster's size; answers are written at once, so that no question is sent again because its
answer is read again (only a task that was lost asks again). Redirects are not followed, as they would carry the key elsewhere. The key
is read from its file where it is used: neither a plan nor a log holds it.
"""

from __future__ import annotations

import http.client
import json
import re
import socket
import ssl
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.sources import epub, files
from bindery.sources.requests import RECORDED
from bindery.storage import materialize

#: The place of a question's named value; the question and the key have places of their own.
_NAMED = re.compile(r"\{(?!request\}|key\})(\w+)\}")
#: No reply is read further than this; a longer one counts as unreadable.
MOST_BYTES = 8 * 1024 * 1024


@dataclass(frozen=True)
class Service:
    """How a question is sent: ``{request}`` and ``{key}`` stand for the question and the key in
    the address (there percent-encoded, unless the question is the whole address), the headers
    and the strings of ``body``. Without a body it is a GET, with one a POST of it as JSON;
    ``body`` may be a function of the question.

    A question that is a JSON object gives its values to the entries of ``query``, which is
    added to the address, and of the body: an entry that is ``"{name}"`` becomes the value of
    that name, whatever it is, and is left out where the question has none. ``forms`` are
    bodies by the question's value of ``form``."""

    address: str
    body: Mapping | Callable[[str], Mapping] | None = None
    headers: Mapping[str, str] = field(default_factory=dict)
    key_file: str | None = None
    timeout: float = 30.0
    pause: float = 0.0
    lanes: int = 1
    query: Mapping[str, str] = field(default_factory=dict)
    forms: Mapping[str, Mapping] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if urllib.parse.urlsplit(self.address.replace("{request}", "x")).scheme not in ("http", "https", ""):
            raise ValueError("only http and https are asked")
        if self.timeout <= 0 or self.pause < 0 or self.lanes < 1:
            raise ValueError("a timeout and lanes are above zero, a pause is not below it")

    def request(self, question: str, key: str) -> urllib.request.Request:
        quoted = {"{request}": urllib.parse.quote(question, safe=""), "{key}": urllib.parse.quote(key, safe="")}
        address = question if self.address == "{request}" else _filled(self.address, quoted)
        plain = {"{request}": question, "{key}": key}
        told = _values(question)
        if query := _filled(self.query, plain, told):
            address += ("&" if "?" in address else "?") + urllib.parse.urlencode(query, quote_via=urllib.parse.quote)
        body = self.forms.get(told.get("form"), self.body)
        body = body(question) if callable(body) else body
        data = None if body is None else json.dumps(_filled(body, plain, told)).encode()
        asked = urllib.request.Request(address, data, {n: _filled(v, plain) for n, v in self.headers.items()})
        if data is not None:
            asked.add_header("Content-Type", "application/json")
        return asked


def _values(question: str) -> dict:
    """The named values of a question; none of one that is a plain text."""
    try:
        told = json.loads(question)
    except ValueError:
        return {}
    return told if isinstance(told, dict) else {}


def _left_out(value, told: Mapping) -> bool:
    return isinstance(value, str) and (name := _NAMED.fullmatch(value)) is not None and name[1] not in told


def _filled(value, given: Mapping[str, str], told: Mapping = {}):
    """A template with its places filled, once each: what is put in is not looked through."""
    if isinstance(value, str):
        if (name := _NAMED.fullmatch(value)) and name[1] in told:
            return told[name[1]]
        parts = [value]
        for place, said in given.items():
            parts = [x for p in parts for x in (_around(p, place, said) if isinstance(p, str) else [p])]
        return "".join(p if isinstance(p, str) else p[0] for p in parts)
    if isinstance(value, Mapping):
        return {k: _filled(v, given, told) for k, v in value.items() if not _left_out(v, told)}
    return [_filled(v, given, told) for v in value] if isinstance(value, (list, tuple)) else value


def _around(text: str, place: str, said: str) -> list:
    first, *rest = text.split(place)
    return [first, *(x for part in rest for x in ((said,), part))]


class _Still(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def went_wrong(error: BaseException) -> str:
    """What an exchange without a status is called, as ``replies.network_failure`` has it."""
    cause = error.reason if isinstance(error, urllib.error.URLError) and isinstance(error.reason, BaseException) else error
    kinds = (
        (TimeoutError, "timeout"), (ConnectionRefusedError, "refused"), (ConnectionError, "reset"),
        (socket.gaierror, "dns"), (ssl.SSLError, "certificate"),
    )
    return next((name for kind, name in kinds if isinstance(cause, kind)), "unreadable")


def exchange(service: Service, question: str, key: str, most: int = MOST_BYTES) -> tuple[int | None, bytes | None, str | None]:
    """(status, body, error) of one question; error is null if there was a status."""
    try:
        opener = urllib.request.build_opener(_Still)
        with opener.open(service.request(question, key), timeout=service.timeout) as reply:
            body = reply.read(most + 1)
            return (reply.status, body, None) if len(body) <= most else (None, None, "unreadable")
    except urllib.error.HTTPError as refusal:
        with refusal:
            try:
                return refusal.code, refusal.read(most), None
            except (OSError, http.client.HTTPException):
                return refusal.code, b"", None
    except (OSError, http.client.HTTPException, ValueError) as error:
        return None, None, went_wrong(error)


def _key(service: Service) -> str:
    if service.key_file is None:
        return ""
    system, path = files._opened(service.key_file)
    with system.open_input_stream(path) as held:
        return files.bare_secret(held.read().decode()) or ""


def _ask(service: Service, questions: DataFrame, answer, schema: str, label: str) -> DataFrame:
    """(request, ...) -> rows of ``answer`` of each, written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for batch in batches:
            for row in batch.to_dict("records"):
                key = _key(service) if key is None else key
                yield pd.DataFrame([answer(row, *exchange(service, row["request"], key))], columns=names)
                time.sleep(service.pause)

    names = [c.split(" ")[0] for c in schema.split(", ")]
    return materialize(questions.repartition(service.lanes).mapInPandas(run, schema), label)


def _text(status: int | None, body: bytes | None, error: str | None) -> tuple[str | None, str | None]:
    """(text, error): a success has to be JSON."""
    if error is not None:
        return None, error
    try:
        text = body.decode()
        if 200 <= status < 300:
            json.loads(text)
        return text, None
    except ValueError:
        return None, "unreadable" if 200 <= status < 300 else None


def transport(service: Service) -> Callable[[DataFrame], DataFrame]:
    """A catalogue: distinct requests -> (request, status, body, error)."""

    def answer(row, status, body, error):
        text, lost = _text(status, body, error)
        return row["request"], status, text, lost

    return lambda wanted: _ask(service, wanted.select("request"), answer, RECORDED, "answers")


def model(service: Service) -> Callable[[DataFrame], DataFrame]:
    """A model: (id, prompt) -> (id, reply), null where it could not be asked."""

    def answer(row, status, body, error):
        text, _ = _text(status, body, error)
        return row["id"], text if status is not None and 200 <= status < 300 else None

    return lambda calls: _ask(service, calls.select("id", F.col("prompt").alias("request")), answer, "id long, reply string", "replies")


def images(service: Service = Service("{request}")) -> Callable[[DataFrame], DataFrame]:
    """Covers: (url) -> (url, body), null for what is not there, is no image or is too large."""

    def answer(row, status, body, error):
        good = error is None and 200 <= status < 300 and epub.image_type(body) is not None
        return row["request"], body if good else None

    wanted = F.col("url").rlike("^https?://")
    return lambda urls: _ask(service, urls.filter(wanted).select(F.col("url").alias("request")), answer, "url string, body binary", "covers")
