"""Physical-plan helpers shared by the operators: sizing, ordering, durability."""
