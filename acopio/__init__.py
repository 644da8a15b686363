"""acopio: retail decision analytics and corpus preparation as Spark programs."""
