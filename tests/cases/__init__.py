"""Small repositories, the queries over them, and the rows that they have to give."""
