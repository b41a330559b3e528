"""Queries by subject; importing this package registers them all."""

from sparkmend.plans import cleaning as cleaning
from sparkmend.plans import gaps as gaps
from sparkmend.plans import governance as governance
from sparkmend.plans import graphs as graphs
from sparkmend.plans import inventory as inventory
from sparkmend.plans import kb as kb
from sparkmend.plans import kb_quality as kb_quality
from sparkmend.plans import more as more
from sparkmend.plans import reports as reports
from sparkmend.plans import retrieval as retrieval
from sparkmend.plans import views as views
from sparkmend.plans.registry import QUERIES as QUERIES
from sparkmend.plans.registry import SQL as SQL
