"""Training-data operators: ten corpus jobs with their queries (see ``queries.py``)."""
