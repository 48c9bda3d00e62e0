"""Providers behind optional packages: a callable (system prompt, message) -> answer. The package is imported where the call is made, on the executors; keys come from the packages' own environment variables."""

from __future__ import annotations

from collections.abc import Callable
from importlib.util import find_spec

#: provider -> the package it needs
PACKAGES = {"gemini": "google.genai", "openai": "openai", "anthropic": "anthropic"}


def installed(name: str) -> bool:
    try:
        return find_spec(PACKAGES[name]) is not None
    except ModuleNotFoundError:
        return False


def _openai(model: str, temperature: float, most: int, system: str, message: str) -> str:
    import openai

    got = openai.OpenAI().chat.completions.create(model=model, temperature=temperature, max_tokens=most, messages=[{"role": "system", "content": system}, {"role": "user", "content": message}])
    return got.choices[0].message.content or ""


def _anthropic(model: str, temperature: float, most: int, system: str, message: str) -> str:
    import anthropic

    got = anthropic.Anthropic().messages.create(model=model, temperature=temperature, max_tokens=most, system=system, messages=[{"role": "user", "content": message}])
    return "".join(part.text for part in got.content if part.type == "text")


def _gemini(model: str, temperature: float, most: int, system: str, message: str) -> str:
    from google import genai

    got = genai.Client().models.generate_content(model=model, contents=message, config={"system_instruction": system, "temperature": temperature, "max_output_tokens": most})
    return got.text or ""


CALLS = {"gemini": _gemini, "openai": _openai, "anthropic": _anthropic}


def provider(name: str, model: str, temperature: float = 0.2, max_output_tokens: int = 8192) -> Callable[[str, str], str]:
    if name not in CALLS:
        raise ValueError(f"no provider {name}; one of {', '.join(CALLS)}")
    if not installed(name):
        raise RuntimeError(f"{name} needs the package {PACKAGES[name]}")
    call = CALLS[name]
    return lambda system, message: call(model, temperature, max_output_tokens, system, message)
