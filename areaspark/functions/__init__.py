from areaspark.functions import dates, missing, numbers, text  # noqa: F401
