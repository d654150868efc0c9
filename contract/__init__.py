"""Registered queries over the driver's tables, each beside its oracle."""
from contract import data, flows, incidents, live, people, perception, stores, text

REGISTRIES = [incidents.R, perception.R, text.R, data.R, people.R, flows.R, live.R, stores.R]
