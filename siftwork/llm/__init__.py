"""Training-data pipeline operators (see README, "Training-data operators").

Each module holds one operator with a general DataFrame interface;
``queries.py`` registers the thin ``opN_*`` queries. Nothing outside this
subpackage imports it.
"""
