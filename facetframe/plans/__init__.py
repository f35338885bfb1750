"""Assembled plans: the wide profile and its presets."""

from facetframe.plans.profile import ProfileTables, build_profile, eligible_titles, flatten_profile  # noqa: F401
