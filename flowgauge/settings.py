"""Flow and report settings."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from flowgauge.functions.time import WEEKS, check_unit


@dataclass(frozen=True)
class FlowSpec:
    """Order of the states of one project and the two states that are measured."""

    reference_flow: Mapping[str, int]
    entry_state: str
    final_state: str
    state_mapping: Mapping[str, str] = field(default_factory=dict)
    estimate_mapping: Mapping[str, float] = field(default_factory=dict)
    priorities: Sequence[str] = ()

    def __post_init__(self):
        if self.entry_state == self.final_state:
            raise ValueError("entry and final state must differ")
        missing = {self.entry_state, self.final_state} - set(self.reference_flow)
        if missing:
            raise ValueError(f"states not in the reference flow: {sorted(missing)}")

    def between(self, entry_state: str | None = None, final_state: str | None = None) -> FlowSpec:
        return replace(
            self,
            entry_state=entry_state or self.entry_state,
            final_state=final_state or self.final_state,
        )


@dataclass(frozen=True)
class FlowReport:
    """One cumulative-flow series: which items, between which states, how bucketed.

    ``types`` or ``priorities`` of ``None`` let every item through.
    """

    qualifier: str
    types: Sequence[str] | None = None
    priorities: Sequence[str] | None = None
    entry_state: str | None = None
    final_state: str | None = None
    unit: str = WEEKS

    def __post_init__(self):
        check_unit(self.unit)


@dataclass(frozen=True)
class Settings:
    flows: Mapping[str, FlowSpec]
    email_mapping: Mapping[str, str]
    estimate_field: str | None = None
    story_points_field: str | None = None
    epic_name_field: str | None = None
    data_location: str = "./"
    reports_location: str = "./"


def load_settings(text: str) -> Settings:
    """Settings from the JSON text of a config file."""
    raw = json.loads(text)
    tracker = raw["jira"]
    flows = {
        project: FlowSpec(
            reference_flow=spec["referenceFlow"],
            entry_state=spec["entryState"],
            final_state=spec["finalState"],
            state_mapping=spec.get("stateMapping", {}),
            estimate_mapping=spec.get("estimateMapping", {}),
            priorities=tuple(spec.get("prios", ())),
        )
        for project, spec in tracker["projects"].items()
    }
    return Settings(
        flows=flows,
        email_mapping=raw.get("emailMapping", {}),
        estimate_field=tracker.get("estimateField"),
        story_points_field=tracker.get("storyPointsField"),
        epic_name_field=tracker.get("epicNameField"),
        data_location=raw.get("data", {}).get("location", "./"),
        reports_location=raw.get("reports", {}).get("location", "./"),
    )
