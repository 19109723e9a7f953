"""Report builders, segment and primitive-operator jobs, query registry."""
