"""Operational contracts around trading: kill switch, deployment gate, brokers, secrets, incidents, alerts, readiness."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class KillSwitch:
    reason: str = ""

    def trip(self, reason: str) -> None:
        self.reason = reason or "tripped"

    def reset(self) -> None:
        self.reason = ""

    def allow(self) -> bool:
        return not self.reason


@dataclass(frozen=True)
class Gate:
    """Refuses with PermissionError what is not enabled, not approved or too large."""

    live: bool = False
    approval_needed: bool = True
    max_notional: float = 10_000.0

    def authorize(self, notional: float, approved: bool = False) -> None:
        if not self.live:
            raise PermissionError("live trading is disabled")
        if self.approval_needed and not approved:
            raise PermissionError("approval is missing")
        if abs(notional) > self.max_notional:
            raise PermissionError(f"{notional} exceeds {self.max_notional}")


@dataclass
class PaperBroker:
    """Fills at the given price while enabled; fails closed otherwise and for anything but paper."""

    enabled: bool = False
    mode: str = "paper"
    positions: dict[str, float] = field(default_factory=dict)
    orders: list[dict] = field(default_factory=list)

    def submit(self, symbol: str, quantity: float, price: float) -> dict:
        if not self.enabled or self.mode != "paper":
            raise PermissionError("the broker takes no orders")
        self.positions[symbol] = self.positions.get(symbol, 0.0) + quantity
        self.orders.append({"symbol": symbol, "quantity": quantity, "price": price, "status": "filled"})
        return self.orders[-1]


@dataclass
class Shadow:
    """Keeps what would have been traded, the last ``most`` decisions, and never submits."""

    most: int = 10_000
    decisions: deque = field(default_factory=deque)

    def record(self, signal: float, market: dict) -> dict:
        self.decisions = deque(self.decisions, self.most)
        self.decisions.append({"signal": signal, "market": market, "would_trade": bool(signal)})
        return self.decisions[-1]


@dataclass(frozen=True)
class BrokerConfig:
    name: str
    url: str
    account: str
    environment: str = "paper"
    key_name: str = ""


@dataclass
class HttpBroker:
    """Orders as JSON to a broker's address. Anything but paper needs a gate that authorises it; a failed request is a RuntimeError.

    transport: (url, payload, headers) -> response text; by default a POST.
    """

    config: BrokerConfig
    gate: Gate | None = None
    transport: Callable[[str, dict, dict], str] | None = None

    def submit(self, symbol: str, quantity: float, price: float, approved: bool = False) -> dict:
        if self.config.environment != "paper":
            if self.gate is None:
                raise PermissionError("live orders need a gate")
            self.gate.authorize(quantity * price, approved)
        headers = {"Authorization": f"Bearer {read_secret(self.config.key_name)}"} if self.config.key_name else {}
        order = {"account": self.config.account, "symbol": symbol, "quantity": quantity, "price": price}
        try:
            return json.loads((self.transport or _post)(self.config.url.rstrip("/") + "/orders", order, headers))
        except (OSError, ValueError) as e:
            raise RuntimeError(f"{self.config.name} did not take the order: {e}") from e


def _post(url: str, payload: dict, headers: dict) -> str:
    ask = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(ask, timeout=10) as reply:
        return reply.read().decode()


def reconciled(internal: dict[str, float], external: dict[str, float], tolerance: float = 1e-8) -> dict[str, tuple[float, float]]:
    """The symbols whose positions differ, with both of them; missing is 0."""
    both = {s: (internal.get(s, 0.0), external.get(s, 0.0)) for s in sorted({*internal, *external})}
    return {s: (a, b) for s, (a, b) in both.items() if abs(a - b) > max(tolerance, 1e-6 * max(abs(a), abs(b)))}


@dataclass
class Secrets:
    """Secrets of a namespace in the environment; missing ones are named all at once, and values never show in its text."""

    namespace: str = "TICKFORGE"

    def get(self, name: str) -> str:
        return read_secret(name, self.namespace)

    def require(self, *names: str) -> None:
        if lost := [n for n in names if f"{self.namespace}_{n}".upper() not in os.environ]:
            raise KeyError(f"missing secrets: {', '.join(lost)}")


def read_secret(name: str, namespace: str = "TICKFORGE") -> str:
    """The environment variable NAMESPACE_NAME; KeyError without it."""
    return os.environ[f"{namespace}_{name}".upper()]


@dataclass
class Health:
    """Heartbeats per component; healthy if none is older than ``stale`` seconds and errors are few."""

    stale: float = 60.0
    max_errors: int = 5
    beats: dict[str, float] = field(default_factory=dict)
    errors: int = 0

    def beat(self, component: str, now: float | None = None) -> None:
        self.beats[component] = time.time() if now is None else now

    def healthy(self, now: float | None = None) -> bool:
        t = time.time() if now is None else now
        return self.errors <= self.max_errors and all(t - b <= self.stale for b in self.beats.values())


@dataclass
class Incidents:
    items: list[dict] = field(default_factory=list)

    def open(self, title: str, severity: str) -> int:
        self.items.append({"id": len(self.items) + 1, "title": title, "severity": severity, "state": "open"})
        return len(self.items)

    def close(self, ident: int, note: str = "") -> None:
        self.items[ident - 1] |= {"state": "closed", "note": note}

    def pending(self) -> list[dict]:
        return [i for i in self.items if i["state"] == "open"]


@dataclass
class Alerts:
    """Routes alerts of a level and above to sinks; a sink that fails does not stop the others."""

    sinks: list[tuple[int, Callable[[dict], None]]] = field(default_factory=list)
    failed: int = 0

    def add(self, level: int, sink: Callable[[dict], None]) -> None:
        self.sinks.append((level, sink))

    def send(self, level: int, text: str) -> int:
        sent = 0
        for least, sink in self.sinks:
            if level >= least:
                try:
                    sink({"level": level, "text": text, "at": time.time()})
                    sent += 1
                except Exception:  # noqa: BLE001
                    self.failed += 1
        return sent


def webhook(url: str) -> Callable[[dict], None]:
    return lambda alert: urllib.request.urlopen(urllib.request.Request(url, json.dumps(alert).encode(), {"Content-Type": "application/json"}), timeout=5).close()


@dataclass
class Readiness:
    """Named checks and approvals; ready when all checks passed and enough people approved."""

    checks: dict[str, bool] = field(default_factory=dict)
    approvals: set[str] = field(default_factory=set)
    needed: int = 1
    records: list[dict] = field(default_factory=list)

    def approve(self, person: str, note: str = "", at: float | None = None) -> dict:
        """Records an approval; a second one by the same person counts once."""
        self.approvals.add(person)
        self.records.append({"person": person, "note": note, "at": time.time() if at is None else at})
        return self.records[-1]

    def ready(self) -> bool:
        return bool(self.checks) and all(self.checks.values()) and len(self.approvals) >= self.needed


def soak(items, handler: Callable) -> dict:
    """Applies handler to each item; counts and keeps the errors."""
    errors, n = [], 0
    for n, x in enumerate(items, 1):
        try:
            handler(x)
        except Exception as e:  # noqa: BLE001
            errors.append(f"{n}: {e}")
    return {"events": n, "errors": errors, "passed": n > 0 and not errors}


def within_budget(took: dict[str, float], budget: dict[str, float]) -> list[str]:
    """The names that took longer than their budget, or were not measured at all."""
    return [n for n, most in budget.items() if took.get(n, float("inf")) > most]


def matches(actual: dict[str, float], expected: dict[str, float], tolerance: float = 1e-9) -> list[str]:
    """The names whose actual value is missing or off the expected by more than the tolerance."""
    return [k for k, v in expected.items() if k not in actual or abs(actual[k] - v) > tolerance]
