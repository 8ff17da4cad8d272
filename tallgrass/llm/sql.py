"""SQL for the text queries that SQL can express. None so far: the others are tested against brute force."""

SQL: dict[str, str] = {}
