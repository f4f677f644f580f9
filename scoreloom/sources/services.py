"""Model services over HTTP as clients of the plans: generation from one prompt, and chat with a system prompt."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass, field

# Options and time limit under which answers can be repeated.
OPTIONS = {"temperature": 0, "seed": 42}
TIMEOUT = 1200
COUNTERS = ("prompt_eval_count", "eval_count", "total_duration", "load_duration", "prompt_eval_duration", "eval_duration", "created_at")


def _post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


@dataclass(frozen=True)
class Generate:
    """record: model_name, prompt. Gives answer, native_thinking and the service's counters. Models that refuse to
    think apart (status 400) are asked once more without it."""

    url: str
    num_ctx: int = 65536
    timeout: float = TIMEOUT

    def __call__(self, record: dict) -> dict:
        body = {"model": record["model_name"], "prompt": record["prompt"], "stream": False, "options": OPTIONS | {"num_ctx": self.num_ctx}}
        try:
            data = _post(self.url, body | {"think": True}, self.timeout)
        except urllib.error.HTTPError as e:
            if e.code != 400:
                raise
            data = _post(self.url, body, self.timeout)
        return {"answer": (data.get("response") or "").strip(), "native_thinking": (data.get("thinking") or "").strip()} | {c: data.get(c) for c in COUNTERS}


@dataclass(frozen=True)
class Chat:
    """The text that a chat gives to the system and user prompts which the templates of the record's stage make of it.

    templates: a pair of texts by stage (map, verify, reduce); fields of the record stand in {braces}."""

    url: str
    model: str
    templates: dict[str, tuple[str, str]] = field(default_factory=dict)
    num_ctx: int = 8192
    timeout: float = TIMEOUT

    def __call__(self, record: dict) -> str:
        system, user = self.templates[record["stage"]]
        said = [{"role": "system", "content": system.format_map(record)}, {"role": "user", "content": user.format_map(record)}]
        data = _post(self.url, {"model": self.model, "messages": said, "stream": False, "options": OPTIONS | {"num_ctx": self.num_ctx}}, self.timeout)
        return ((data.get("message") or {}).get("content") or "").strip()
