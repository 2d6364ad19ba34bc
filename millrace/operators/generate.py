"""Language models and embedders behind small client objects, called once per row from Arrow UDFs with a thread pool per batch."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np

from ..functions.filters import extract_json, json_path


class HTTPModel:
    """Chat completions over HTTP. The key travels with the client, so keep it out of logs."""

    def __init__(self, url: str, model: str, headers: dict[str, str], max_tokens: int = 1024, temperature: float = 0.1, timeout: float = 120):
        self.url, self.model, self.headers, self.max_tokens, self.temperature, self.timeout = url, model, headers, max_tokens, temperature, timeout

    def body(self, messages: list[dict], schema: dict | None, max_tokens: int | None, temperature: float | None) -> dict:
        body = {"model": self.model, "messages": messages, "max_tokens": max_tokens or self.max_tokens, "temperature": self.temperature if temperature is None else temperature}
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": schema if "schema" in schema else {"name": "answer", "schema": schema, "strict": True}}
        return body

    def process(self, messages: list[dict], schema: dict | None = None, max_tokens: int | None = None, temperature: float | None = None) -> str | None:
        request = urllib.request.Request(self.url, json.dumps(self.body(messages, schema, max_tokens, temperature)).encode(), {"Content-Type": "application/json", **self.headers})
        with urllib.request.urlopen(request, timeout=self.timeout) as f:
            return json.load(f)["choices"][0]["message"]["content"]


def api_model(base_url: str, api_key: str, model: str, **options: Any) -> HTTPModel:
    base = base_url.rstrip("/")
    base = base[:-3] if base.endswith("/v1") else base
    return HTTPModel(f"{base}/v1/chat/completions", model, {"Authorization": f"Bearer {api_key}"}, **options)


def openai_model(api_key: str, model: str, **options: Any) -> HTTPModel:
    return api_model("https://api.openai.com", api_key, model, **options)


def azure_model(api_key: str, endpoint: str, deployment: str, api_version: str, **options: Any) -> HTTPModel:
    return HTTPModel(f"{endpoint.rstrip('/')}/openai/deployments/{deployment}/chat/completions?api-version={api_version}", deployment, {"api-key": api_key}, **options)


class LocalModel:
    """Any object with process(messages, schema, max_tokens, temperature), made once per Python worker by `make`; a schema becomes a system message."""

    def __init__(self, make: Callable[[], Any]):
        self.make, self._model = make, None

    def __getstate__(self) -> dict:
        return {"make": self.make, "_model": None}

    def process(self, messages: list[dict], schema: dict | None = None, max_tokens: int | None = None, temperature: float | None = None) -> str | None:
        if self._model is None:
            self._model = self.make()
        if schema:
            messages = [{"role": "system", "content": "Answer with JSON that fits this schema: " + json.dumps(schema)}, *messages]
        return self._model.process(messages, schema, max_tokens, temperature)


class FakeModel:
    """Deterministic answers for tests: a function of the messages, or a JSON object that fits the schema's required names."""

    def __init__(self, answer: Callable[[list[dict], dict | None], str] | None = None):
        self.answer = answer

    def process(self, messages: list[dict], schema: dict | None = None, max_tokens: int | None = None, temperature: float | None = None) -> str | None:
        if self.answer:
            return self.answer(messages, schema)
        seed = hashlib.sha256(json.dumps(messages, sort_keys=True).encode()).hexdigest()
        if schema:
            own = schema.get("schema", schema)
            fill = {"string": seed[:8], "integer": int(seed[:4], 16) % 5 + 1, "number": int(seed[:4], 16) % 5 + 1, "boolean": seed[0] > "7", "array": [], "object": {}}
            return json.dumps({k: fill.get(p.get("type"), seed[:8]) for k, p in own.get("properties", {}).items()})
        return f"answer {seed[:12]}"


def answers(model: Any, prompts: Sequence[list[dict] | None], schema: dict | None, max_tokens: int | None, temperature: float | None, threads: int = 8) -> list[str | None]:
    """Answers in order; an error or no prompt gives None."""

    def one(messages: list[dict] | None) -> str | None:
        if messages is None:
            return None
        try:
            return model.process(messages, schema, max_tokens, temperature)
        except Exception:  # a failed call fails its row only
            return None

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(one, prompts))


def json_answer(text: str | None, path: str | None) -> Any:
    value = extract_json(text)
    return json_path(value, path) if path and value is not None else value


class HashEmbedder:
    """Unit vectors of hashed character trigrams: deterministic and offline."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.width)
            s = f" {t.lower()} "
            for i in range(len(s) - 2):
                h = int.from_bytes(hashlib.md5(s[i : i + 3].encode(), usedforsecurity=False).digest()[:4], "little")
                v[h % self.width] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class HTTPEmbedder:
    def __init__(self, base_url: str, api_key: str, model: str):
        base = base_url.rstrip("/")
        self.url, self.key, self.model = (base[:-3] if base.endswith("/v1") else base) + "/v1/embeddings", api_key, model

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        request = urllib.request.Request(self.url, json.dumps({"model": self.model, "input": list(texts)}).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=120) as f:
            return [d["embedding"] for d in json.load(f)["data"]]


class E5Embedder:
    """A sentence model of the local machine, loaded once per Python worker; needs the sentence-transformers package."""

    def __init__(self, repo: str):
        self.repo, self._model = repo, None

    def __getstate__(self) -> dict:
        return {"repo": self.repo, "_model": None}

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.repo)
        return self._model.encode([f"query: {t}" for t in texts], normalize_embeddings=True).tolist()


#: What each kind of judge rates, and what the ends of the scale mean, by language.
_RATES = {
    "conversation": {
        "helpfulness": ("Does the assistant do what the user wants, wholly and without detours?", "Czy asystent robi to, o co prosi użytkownik, w całości i bez zbędnych dygresji?"),
        "accuracy": ("Are the facts, figures and conclusions right, and are doubts named as such?", "Czy fakty, liczby i wnioski są prawdziwe, a wątpliwości nazwane wprost?"),
        "coherence": ("Do the turns follow from one another, without contradiction or repetition?", "Czy kolejne wypowiedzi wynikają z poprzednich, bez sprzeczności i powtórzeń?"),
        "language": ("Is the wording natural, correct, and in the user's own language and tone?", "Czy język jest naturalny, poprawny i zgodny z językiem i tonem użytkownika?"),
    },
    "conversation_lite": {"overall": ("How good is the conversation as an example to learn from?", "Jak dobrym przykładem do nauki jest ta rozmowa?")},
    "tools_calling": {
        "tool_choice": ("Is a tool called where one is needed, the right one, and none where none is?", "Czy narzędzie jest wywołane tam, gdzie trzeba, właściwe, a tam, gdzie nie trzeba, żadne?"),
        "arguments": ("Are all required arguments there, of the right type, and taken from the conversation rather than invented?", "Czy są wszystkie wymagane argumenty, właściwego typu i wzięte z rozmowy, a nie wymyślone?"),
        "use_of_results": ("Does the assistant read the results as they are, and deal with errors and empty ones?", "Czy asystent wiernie odczytuje wyniki i radzi sobie z błędami oraz brakiem wyników?"),
        "answer": ("Does the last answer settle the user's question on the ground of what the tools gave?", "Czy ostatnia odpowiedź rozstrzyga pytanie użytkownika na podstawie tego, co zwróciły narzędzia?"),
    },
    "tools_calling_lite": {"overall": ("How well are the tools used to answer the user?", "Jak dobrze użyto narzędzi, by odpowiedzieć użytkownikowi?")},
}
_SCALES = {kind: tuple(rates) for kind, rates in _RATES.items()}
_JUDGE = {
    "en": """You examine conversations from which a language model is to learn. Judge the one below strictly: a mistake that a careful reader would notice costs at least one point.

What to rate, each with a whole number:
{rates}

The scale:
1 - harmful or useless: must not be learned from
2 - serious faults
3 - usable, with plain weaknesses
4 - good, with small blemishes
5 - nothing to improve
{tools}
The conversation, as JSON messages in order:
{messages}

Think it through first, then answer with nothing but one JSON object of this form:
{form}""",
    "pl": """Oceniasz rozmowy, na których ma się uczyć model językowy. Poniższą oceń surowo: błąd, który zauważyłby uważny czytelnik, kosztuje co najmniej jeden punkt.

Co oceniasz, zawsze liczbą całkowitą:
{rates}

Skala:
1 - szkodliwa lub bezużyteczna: nie wolno się na niej uczyć
2 - poważne błędy
3 - do użycia, z wyraźnymi słabościami
4 - dobra, z drobnymi usterkami
5 - nie ma czego poprawiać
{tools}
Rozmowa, jako kolejne wiadomości w formacie JSON:
{messages}

Najpierw przemyśl ocenę, a potem odpowiedz wyłącznie jednym obiektem JSON w tej postaci:
{form}""",
}
_TOOLS = {"en": "\nThe tools that the assistant may call, as JSON; a name or argument that isn't here is a fault:\n", "pl": "\nNarzędzia, których asystent może użyć, w formacie JSON; nazwa lub argument spoza listy jest błędem:\n"}


def judge_prompt(kind: str, language: str, messages: Any, tools: Any) -> str:
    """What a judge is asked of a conversation; another language than en and pl gets the English text."""
    language = language if language in _JUDGE else "en"
    rates = "\n".join(f"- {name}: {texts[language == 'pl']}" for name, texts in _RATES[kind].items())
    part = _TOOLS[language] + json.dumps(tools, ensure_ascii=False) + "\n" if kind.startswith("tools_calling") else ""
    form = "{" + "".join(f'"{name}": 1-5, ' for name in _RATES[kind]) + '"comment": "..."}'
    return _JUDGE[language].format(rates=rates, tools=part, messages=json.dumps(messages, ensure_ascii=False, indent=1), form=form)


def judge_schema(kind: str) -> dict:
    names = _SCALES[kind]
    return {"type": "object", "properties": {**{n: {"type": "integer", "minimum": 1, "maximum": 5} for n in names}, "comment": {"type": "string"}}, "required": [*names], "additionalProperties": False}
