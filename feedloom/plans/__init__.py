

from feedloom.plans import aggregates, episodes, extras, filters, joins, ranked, searches, stored, texts  # noqa: F401  they register themselves
