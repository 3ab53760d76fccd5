"""Model connectors (O06) behind one interface: requests in, answers out, one session per task."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "request string, response string, error string"


class Extractor:
    """``answer(system, user)`` gives a text or raises; :meth:`run` maps it over request rows."""

    def answer(self, system: str, user: str) -> str:
        raise NotImplementedError

    def run(self, requests: DataFrame) -> DataFrame:
        """``requests`` (request, system, user) to (request, response, error). An error is a row, not a failed job."""

        def ask(batches):
            import pyarrow as pa

            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    try:
                        out.append({"request": r["request"], "response": self.answer(r["system"], r["user"]), "error": None})
                    except Exception as e:  # noqa: BLE001  any failure of one call is that row's error
                        out.append({"request": r["request"], "response": None, "error": f"{type(e).__name__}: {e}"})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, pa.string()) for c in ("request", "response", "error")]))

        return requests.select("request", "system", "user").mapInArrow(ask, ANSWER)


@dataclass
class HttpChatExtractor(Extractor):
    """Chat-completions endpoint: bearer header, optional system message, the user's text as one part."""

    base_url: str
    model: str
    api_key: str = ""
    max_tokens: int = 1000
    temperature: float = 0.2
    timeout_s: float = 120
    retries: int = 2

    def payload(self, system: str, user: str) -> dict:
        messages = [{"role": "system", "content": system}] if system else []
        messages.append({"role": "user", "content": [{"type": "text", "text": user}]})
        return {"model": self.model, "messages": messages, "max_tokens": self.max_tokens, "temperature": self.temperature}

    def answer(self, system: str, user: str) -> str:
        body = json.dumps(self.payload(system, user)).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}
        for k in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.base_url, body, head), timeout=self.timeout_s) as r:
                    return json.load(r)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as e:
                if k == self.retries or e.code < 500 and e.code != 429:
                    raise
            except urllib.error.URLError:
                if k == self.retries:
                    raise
            time.sleep(2**k)
        raise RuntimeError("unreachable")


def prompt_hash(system: str, user: str) -> str:
    return hashlib.sha256(f"{system}\0{user}".encode()).hexdigest()


@dataclass
class RecordedExtractor(Extractor):
    """Answers by the prompt's hash, from a table (hash, response): a join, so that recordings of any size work."""

    recordings: DataFrame

    def run(self, requests: DataFrame) -> DataFrame:
        key = F.sha2(F.concat("system", F.lit("\0"), "user"), 256)
        known = self.recordings.select(F.col("hash").alias("_hash"), "response")
        both = requests.withColumn("_hash", key).join(known, "_hash", "left")
        return both.select("request", "response", F.when(F.col("response").isNull(), "no recording").alias("error"))


class RuleExtractor(Extractor):
    """Triples without a model: 'X verb Y' by a short list of verbs, sentence by sentence."""

    VERBS = ("invented", "built", "led to", "lives in", "is located in", "works for", "owns", "wrote", "founded", "powers", "uses", "caused")
    FORM = re.compile(rf"^\s*(.+?)\s+({'|'.join(VERBS)})\s+(.+?)\s*$", re.I)

    def answer(self, system: str, user: str) -> str:
        text = user.rsplit("<<<", 1)[-1].split(">>>", 1)[0]
        out = []
        for sentence in re.split(r"[.!?\n]+", text):
            if m := self.FORM.match(sentence):
                out.append({"subject": m[1].lower(), "predicate": m[2].lower(), "object": m[3].lower()})
        return json.dumps(out)
