"""Settings from the environment (SRC-11, CFG-1)."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field


def env_bool(env: Mapping[str, str], name: str, default: bool) -> bool:
    raw = env.get(name)
    return default if raw is None else raw.strip().lower() in {"1", "true", "yes", "on"}


def env_float(env: Mapping[str, str], name: str, default: float) -> float:
    raw = env.get(name)
    return default if raw is None else float(raw)


def env_int(env: Mapping[str, str], name: str, default: int) -> int:
    raw = env.get(name)
    return default if raw is None else int(raw)


def env_list(env: Mapping[str, str], name: str, default: tuple[str, ...]) -> tuple[str, ...]:
    raw = env.get(name)
    return default if raw is None else tuple(x.strip().rstrip("/") for x in raw.split(",") if x.strip())


@dataclass(frozen=True)
class Settings:
    app_name: str = "sedge"
    environment: str = "local"
    version: str = "0.1.0"
    debug: bool = True
    generator: str = "openai"
    ollama_url: str = "http://localhost:11434"
    #: Asked in turn if ollama_url does not answer: a server on this machine, or on the host of this container.
    ollama_others: tuple[str, ...] = ("http://127.0.0.1:11434", "http://host.docker.internal:11434", "http://172.17.0.1:11434")
    ollama_model: str = "qwen2.5:1.5b"
    ollama_timeout: float = 180
    ollama_tokens: int = 800
    openai_key: str | None = field(default=None, repr=False)
    openai_model: str = "gpt-4o-mini"
    openai_temperature: float = 0.2
    openai_tokens: int = 800

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        d = cls()
        return cls(
            app_name=env.get("APP_NAME", d.app_name), environment=env.get("APP_ENV", d.environment), version=env.get("APP_VERSION", d.version), debug=env_bool(env, "DEBUG", d.debug),
            generator=env.get("LLM_PROVIDER", d.generator).strip().lower(), ollama_url=env.get("OLLAMA_BASE_URL", d.ollama_url).rstrip("/"), ollama_others=env_list(env, "OLLAMA_OTHER_URLS", d.ollama_others), ollama_model=env.get("OLLAMA_MODEL", d.ollama_model),
            ollama_timeout=env_float(env, "OLLAMA_TIMEOUT", d.ollama_timeout), ollama_tokens=env_int(env, "OLLAMA_NUM_PREDICT", d.ollama_tokens), openai_key=env.get("OPENAI_API_KEY"), openai_model=env.get("OPENAI_MODEL", d.openai_model),
            openai_temperature=env_float(env, "OPENAI_TEMPERATURE", d.openai_temperature), openai_tokens=env_int(env, "OPENAI_MAX_OUTPUT_TOKENS", d.openai_tokens),
        )
