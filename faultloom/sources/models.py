"""Model calls over tables of cards: rounds with tools, retries, statuses. Clients are pluggable; nothing here opens a network connection."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

MAX_ROUNDS, NUDGE_ROUND, ATTEMPTS, TOOL_CHARS = 12, 9, 3, 24_000
RESULT = "task_id string, status string, content string, rounds int, tool_trace string, error string"
#: A client answers a list of messages with ``{"content": text or None, "tool_calls": [{"name", "args"}, ...]}``.
Client = Callable[[list[dict], bool], dict]
Tool = Callable[[str, dict], str]
NUDGE = "Few tool rounds are left: give the final JSON as soon as the evidence suffices."
FINAL = "No tool rounds are left: answer with the final JSON only."


def _asked(client: Client, messages: list[dict], tools: bool, wait: float) -> dict:
    import time

    for n in range(ATTEMPTS):
        try:
            return client(messages, tools)
        except Exception:  # noqa: BLE001 - whatever a remote service raises
            if n == ATTEMPTS - 1:
                raise
            time.sleep(wait * 2**n)
    raise AssertionError


def converse(prompt: str, client: Client, tool: Tool, max_rounds: int = MAX_ROUNDS, wait: float = 1.0) -> tuple[str, str, int, list[dict], str]:
    """One card's conversation: ``status, content, rounds, trace, error``.

    Tool calls are answered round by round, their results cut to ``TOOL_CHARS``; the model is nudged near the end and, after
    the last round, must answer without tools. A call that keeps failing ends the card with ``api_error``, an answer without JSON
    with ``json_parse_failed``; neither stops the others.
    """
    messages, trace = [{"role": "user", "content": prompt}], []
    try:
        for n in range(1, max_rounds + 1):
            if n == NUDGE_ROUND:
                messages.append({"role": "user", "content": NUDGE})
            answer = _asked(client, messages, True, wait)
            calls = answer.get("tool_calls") or []
            if not calls:
                return _judged(answer.get("content") or "", n - 1, trace)
            messages.append({"role": "assistant", "content": answer.get("content") or "", "tool_calls": calls})
            for call in calls:
                trace.append({"round": n, "tool": call["name"], "args": call.get("args", {})})
                try:
                    text = tool(call["name"], call.get("args", {}))
                except Exception as e:  # noqa: BLE001 - the model is told
                    text = json.dumps({"error": str(e)})
                messages.append({"role": "tool", "content": text if len(text) <= TOOL_CHARS else text[:TOOL_CHARS] + "\n...[truncated]..."})
        messages.append({"role": "user", "content": FINAL})
        return _judged(_asked(client, messages, False, wait).get("content") or "", max_rounds, trace)
    except Exception as e:  # noqa: BLE001
        return "api_error", "", len({t["round"] for t in trace}), trace, str(e)


def _judged(content: str, rounds: int, trace: list[dict]) -> tuple[str, str, int, list[dict], str]:
    found = re.search(r"\{.*\}", content, re.S)
    try:
        json.loads(found.group(0) if found else "")
        return "ok", content, rounds, trace, ""
    except ValueError:
        return "json_parse_failed", content, rounds, trace, "no JSON object in the answer"


def answers(tasks: DataFrame, client: Callable[[], Client], tool: Callable[[], Tool], parallelism: int | None = None) -> DataFrame:
    """``task_id, status, content, rounds, tool_trace, error`` for ``task_id, prompt`` rows.

    Client and tools are made once per task of the engine. ``parallelism`` bounds the number of conversations at a
    time. A task that is run again repeats its conversations: keep results in a table and pass only pending tasks.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, t = client(), tool()
        for pdf in parts:
            rows = []
            for task_id, prompt in zip(pdf["task_id"], pdf["prompt"], strict=True):
                status, content, rounds, trace, error = converse(prompt, c, t)
                rows.append((task_id, status, content, rounds, json.dumps(trace), error))
            yield pd.DataFrame(rows, columns=["task_id", "status", "content", "rounds", "tool_trace", "error"])

    df = tasks.select("task_id", "prompt")
    return (df.repartition(parallelism) if parallelism else df).mapInPandas(run, RESULT)


def status_counts(results: DataFrame) -> DataFrame:
    """Results per status."""
    return results.groupBy("status").count()


def load_prompt(path: str) -> str:
    """The prompt contract a model gets, without outer blanks; the file is required and must not be blank."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"the prompt file is missing: {path}")
    with open(path, encoding="utf-8") as f:
        text = f.read().strip()
    if not text:
        raise ValueError(f"the prompt file is blank: {path}")
    return text


def load_env_file(path: str) -> dict[str, str]:
    """``KEY=VALUE`` and ``$env:KEY=VALUE`` lines put into the environment unless set; comments and blanks are skipped."""
    added: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8", errors="replace") as f:
            for line in f:
                m = re.match(r"\s*(?:\$env:)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
                if m and not line.lstrip().startswith("#"):
                    key, value = m.group(1), m.group(2).strip("\"'")
                    if key not in os.environ:
                        os.environ[key] = added[key] = value
    return added


def load_api_file(path: str) -> tuple[str | None, str | None]:
    """Base URL and bearer token found in a file, in whichever of three encodings it decodes; for the driver only."""
    with open(path, "rb") as f:
        data = f.read()
    for encoding in ("utf-8", "gbk", "gb18030"):
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        text = data.decode("utf-8", "replace")
    url, key = re.search(r"https?://[^\s\"'<>]+", text), re.search(r"(?:Bearer\s+|\b)(sk-[A-Za-z0-9_-]{8,})", text)
    return url and url.group(0), key and key.group(1)
