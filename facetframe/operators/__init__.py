"""DataFrame operators (DataFrames and plain parameters in, DataFrame out)."""

from facetframe.operators.distributions import (age_pyramid, breakdown, by_decade,  # noqa: F401
                                                distribution, facet_distributions, histogram,
                                                kpis, rating_distribution)
from facetframe.operators.enrich import (bridge_rollup, first_per_key,  # noqa: F401
                                         list_per_key, lookup_with_fallback)
from facetframe.operators.facets import all_facet_values, facet_values  # noqa: F401
from facetframe.operators.filters import (FilterSpec, filter_mentions, filter_titles,  # noqa: F401
                                          titles_with_location, titles_with_theme)
from facetframe.operators.geo import intensity, map_metric, share_of_max  # noqa: F401
from facetframe.operators.mentions import (location_mentions, location_options,  # noqa: F401
                                           mention_table, mentions_by_country, primary_country,
                                           titles_by_country)
from facetframe.operators.paging import (film_page, location_page, page, page_after,  # noqa: F401
                                         page_info, person_page)
from facetframe.operators.people import by_country, people_by_country, people_table, top_countries  # noqa: F401
from facetframe.operators.places import classify_names, classify_places  # noqa: F401
from facetframe.operators.themes import (ThemeResult, theme_mentions, theme_option_tree,  # noqa: F401
                                         theme_options)
