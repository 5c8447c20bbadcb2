"""DataFrame operators of the inventory: dialogue history, gold ratings, ranks, agreement,
mining, submissions, retrieval, features, scoring and regression."""
