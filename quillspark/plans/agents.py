"""Models and agents made from configurations: plain, cached, recorded.

A model is a callable registered under a name; nothing is downloaded or imported.
"""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Sequence
from typing import Any

from .config import AgentConfig, Config, ModelConfig
from .pipeline import Registry
from .runs import CacheTable, CachingRun, ChatRun, RecordingRun, Run, default_key


class ModelFactory:
    """``make()`` gives the callable registered as ``model.<name>``, called with the
    configuration's other values."""

    def __init__(self, config: ModelConfig, registry: Registry) -> None:
        self.config, self.registry = config, registry

    def make(self) -> Callable[[list[dict]], Any]:
        values = self.config.to_kwargs()
        return self.registry.resolve({"_target_": f"model.{values.pop('model')}", **values})


class CachingModel:
    """A model whose replies are kept by messages, stop words and other arguments.
    Tools that are bound count as arguments."""

    def __init__(self, model: Callable[..., Any], key_fn: Callable[[Any], str] = default_key, **bound: Any) -> None:
        self.model, self.key_fn, self.bound = model, key_fn, bound
        self._known: dict[str, Any] = {}

    def bind(self, **kwargs: Any) -> CachingModel:
        made = CachingModel(self.model, self.key_fn, **{**self.bound, **kwargs})
        made._known = self._known
        return made

    def __call__(self, messages: Sequence[dict], stop: Sequence[str] | None = None, **kwargs: Any) -> Any:
        arguments = {**self.bound, **kwargs}
        key = self.key_fn({"messages": list(messages), "stop": stop, "kwargs": arguments})
        if key not in self._known:
            extra = arguments | ({"stop": stop} if stop is not None else {})
            self._known[key] = self.model(list(messages), **extra)
        return self._known[key]

    async def acall(self, messages: Sequence[dict], stop: Sequence[str] | None = None, **kwargs: Any) -> Any:
        """The same without holding up the event loop."""
        return await asyncio.to_thread(self, messages, stop, **kwargs)


class AgentFactory:
    """An agent: a model behind message coercion and a system prompt."""

    def __init__(self, config: AgentConfig, registry: Registry) -> None:
        self.config, self.registry = config, registry

    def make(self) -> Run:
        model = self.config.model
        if not isinstance(model, ModelConfig):
            raise TypeError("the agent's model must be a ModelConfig")
        return ChatRun(ModelFactory(model, self.registry).make(), system_prompt=self.config.system_prompt)


class CachingAgentFactory:
    def __init__(self, inner: Any, cache: CacheTable | None = None) -> None:
        self.inner, self.cache = inner, cache

    def make(self) -> CachingRun:
        return CachingRun(self.inner.make(), self.cache)


class RecordingAgentFactory:
    """Records carry the configuration's key, so runs of one set-up can be found."""

    def __init__(self, inner: Any, store: Any, *, config: Config | None = None, extra: dict[str, Any] | None = None) -> None:
        self.inner, self.store = inner, store
        self.extra = dict(extra or {}) | ({"config_key": config.cache_key()} if config else {})

    def make(self) -> RecordingRun:
        return RecordingRun(self.inner.make(), self.store, extra=self.extra)
