"""Program text for what an edge's configuration asks for: retries, a circuit breaker, a client of an HTTP service.

Python and Node get code; other languages a comment that says what is asked for. An edge that doesn't ask gets no text.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

# Languages, and what holds where the edge doesn't say.
LANGUAGES = ("python", "nodejs", "java", "csharp", "go")
BACKOFF_MS, FAILURES, RESET_MS, CLIENT_TIMEOUT_MS, STRATEGY, PROTOCOL = 1000, 5, 60000, 30000, "exponential", "https"

_RETRY = {
    "python": '''import random
import time


def retry_with_{strategy}_backoff(func, max_attempts={attempts}, backoff_ms={backoff}):
    """Calls func until it succeeds, max_attempts times at most, and waits in between."""
    for attempt in range(max_attempts):
        try:
            return func()
        except Exception:
            if attempt + 1 >= max_attempts:
                raise
            time.sleep({wait})
''',
    "nodejs": """const retryWith{Strategy}Backoff = async (work, maxAttempts = {attempts}, backoffMs = {backoff}) => {{
  for (let attempt = 0; ; attempt += 1) {{
    try {{
      return await work();
    }} catch (error) {{
      if (attempt + 1 >= maxAttempts) throw error;
      await new Promise((done) => setTimeout(done, {wait}));
    }}
  }}
}};
""",
}
_WAIT = {
    ("python", "exponential"): "backoff_ms * 2**attempt / 1000 + random.uniform(0, 0.1)",
    ("python", "linear"): "backoff_ms / 1000",
    ("nodejs", "exponential"): "backoffMs * 2 ** attempt + Math.random() * 100",
    ("nodejs", "linear"): "backoffMs",
}

_BREAKER = {
    "python": '''import time


class CircuitBreaker:
    """Refuses calls for a while after too many failures; the first call after that decides whether it closes."""

    def __init__(self, failure_threshold={failures}, reset_timeout_ms={reset}):
        self.failure_threshold = failure_threshold
        self.reset_timeout_ms = reset_timeout_ms
        self.failures = 0
        self.opened_at = None

    def call(self, func):
        trial = self.opened_at is not None
        if trial and (time.monotonic() - self.opened_at) * 1000 <= self.reset_timeout_ms:
            raise RuntimeError("circuit is open")
        try:
            result = func()
        except Exception:
            self.failures += 1
            if self.failures >= self.failure_threshold:
                self.opened_at = time.monotonic()
            raise
        if trial:
            self.failures, self.opened_at = 0, None
        return result
''',
    "nodejs": """class CircuitBreaker {{
  constructor(failureThreshold = {failures}, resetTimeoutMs = {reset}) {{
    Object.assign(this, {{ failureThreshold, resetTimeoutMs, failures: 0, openedAt: null }});
  }}

  async call(work) {{
    const trial = this.openedAt !== null;
    if (trial && Date.now() - this.openedAt <= this.resetTimeoutMs) throw new Error('circuit is open');
    try {{
      const result = await work();
      if (trial) Object.assign(this, {{ failures: 0, openedAt: null }});
      return result;
    }} catch (error) {{
      this.failures += 1;
      if (this.failures >= this.failureThreshold) this.openedAt = Date.now();
      throw error;
    }}
  }}
}}
""",
}


def _config(edge: Mapping[str, Any], name: str | None = None) -> Mapping[str, Any]:
    config = edge.get("config")
    found = config.get(name) if name and isinstance(config, Mapping) else config
    return found if isinstance(found, Mapping) else {}


def _checked(language: str) -> str:
    if language not in LANGUAGES:
        raise ValueError(f"language must be one of {LANGUAGES}, not {language!r}")
    return language


def strategy_of(retry: Mapping[str, Any]) -> str:
    """exponential, or linear for all else that is asked for."""
    return "exponential" if (retry.get("strategy") or STRATEGY) == "exponential" else "linear"


def asks_for_retry(edge: Mapping[str, Any]) -> bool:
    return (_config(edge, "retry").get("maxAttempts") or 0) > 0


def asks_for_breaker(edge: Mapping[str, Any]) -> bool:
    return bool(_config(edge, "circuitBreaker").get("enabled"))


def retry_text(edge: Mapping[str, Any], language: str) -> str:
    """A function that repeats what fails, as the edge's `retry` has it; the linear one waits as long each time."""
    if not asks_for_retry(edge):
        return ""
    retry = _config(edge, "retry")
    attempts, strategy, backoff = retry["maxAttempts"], strategy_of(retry), retry.get("backoffMs") or BACKOFF_MS
    if _checked(language) not in _RETRY:
        return f"// retry: {attempts} attempts, {retry.get('strategy') or STRATEGY} backoff from {backoff} ms"
    return _RETRY[language].format(strategy=strategy, Strategy=strategy.capitalize(), attempts=attempts, backoff=backoff, wait=_WAIT[language, strategy])


def breaker_text(edge: Mapping[str, Any], language: str) -> str:
    """A circuit breaker, as the edge's `circuitBreaker` has it."""
    if not asks_for_breaker(edge):
        return ""
    breaker = _config(edge, "circuitBreaker")
    failures, reset = breaker.get("failureThreshold") or FAILURES, breaker.get("resetTimeoutMs") or RESET_MS
    if _checked(language) not in _BREAKER:
        return f"// circuit breaker: opens after {failures} failures for {reset} ms"
    return _BREAKER[language].format(failures=failures, reset=reset)


def client_text(edge: Mapping[str, Any], url: str, method: str, language: str) -> str:
    """A call of `url`, which has no scheme, within the edge's timeout, repeated and guarded as the edge asks for."""
    whole = f"{edge.get('protocol') or PROTOCOL}://{url}"
    timeout = _config(edge).get("timeout") or CLIENT_TIMEOUT_MS
    verb = method.lower()
    if _checked(language) not in _RETRY:
        return f"// client: {method} {whole} within {timeout} ms"
    helpers = [x for x in (retry_text(edge, language), breaker_text(edge, language)) if x]
    retry = strategy_of(_config(edge, "retry"))
    call = "request"
    if language == "python":
        rows = ["import httpx", "", *helpers, "", "def request():", f"    answer = httpx.request({json.dumps(verb.upper())}, {json.dumps(whole)}, timeout={timeout / 1000})", "    answer.raise_for_status()", "    return answer.json()", "", ""]
        if asks_for_breaker(edge):
            rows += ["breaker = CircuitBreaker()", "", ""]
            call = "lambda: breaker.call(request)"
        rows.append(f"result = retry_with_{retry}_backoff({call})" if asks_for_retry(edge) else "result = request()" if call == "request" else "result = breaker.call(request)")
    else:
        rows = [*helpers, "const request = async () => {", f"  const answer = await fetch({json.dumps(whole)}, {{ method: {json.dumps(verb.upper())}, signal: AbortSignal.timeout({timeout}) }});", "  if (!answer.ok) throw new Error(`status ${answer.status}`);", "  return answer.json();", "};", ""]
        if asks_for_breaker(edge):
            rows += ["const breaker = new CircuitBreaker();"]
            call = "() => breaker.call(request)"
        rows.append(f"const result = await retryWith{retry.capitalize()}Backoff({call});" if asks_for_retry(edge) else "const result = await request();" if call == "request" else "const result = await breaker.call(request);")
    return "\n".join(rows) + "\n"
